"""Drafts and their revisions: citations, sections, spans, differences, resolution of findings, exports."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.functions import text as X
from tessera.registry import query
from tessera.sources.tables import table

BLANKS = r"[\x20\x09-\x0D]+"


@query(rf"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(text, '“', '"'), '–', '-'), '[*_`#>|]', '', 'g'), '{BLANKS}', ' ', 'g'))) AS plain FROM documents
""")
def t16_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and dashes folded, without marks of markup, white space collapsed."""
    folded = F.translate("text", "“–", '"-')
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.regexp_replace(folded, "[*_`#>|]", ""), BLANKS, " ")), 256).alias("plain"))


def draft_sections(drafts: DataFrame, key: str, text: Column) -> DataFrame:
    """Paragraphs of each draft with the heading above them: key, position, title, content."""
    parts = F.filter(F.transform(F.split(text, r"\n\n+"), lambda p: F.trim(p)), lambda p: p != "")
    blocks = drafts.select(key, F.posexplode(parts).alias("position", "block"))
    title = F.nullif(F.regexp_extract("block", r"^#{1,3}[\x20\x09]+([^\n]+)$", 1), F.lit(""))
    above = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    titled = blocks.withColumn("heading", title).withColumn("title", F.last("heading", ignorenulls=True).over(above))
    return titled.where("heading IS NULL").select(key, "position", "title", F.col("block").alias("content"))


@query(r"""
WITH d AS (SELECT conv_id || '-' || turn AS draft, string_split_regex('# Part ' || conv_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Rest' || chr(10) || chr(10) || 'End.', '\n\n+') AS bs FROM conversations),
b AS (SELECT draft, unnest(range(len(l))) AS pos, unnest(l) AS block FROM (SELECT draft, list_filter(list_transform(bs, lambda x: trim(x)), lambda x: x <> '') AS l FROM d)),
h AS (SELECT *, nullif(regexp_extract(block, '^#{1,3}[\x20\x09]+([^\n]+)$', 1), '') AS heading FROM b)
SELECT draft, pos::INT AS position, title, block AS content FROM (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY draft ORDER BY pos ROWS UNBOUNDED PRECEDING) AS title FROM h) WHERE heading IS NULL
""")
def t17_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Part "), "conv_id", F.lit("\n\n"), "text", F.lit("\n\n## Rest\n\nEnd."))
    return draft_sections(table(spark, sf_dir, "conversations").withColumn("draft", F.concat_ws("-", "conv_id", "turn")), "draft", text)


@query(r"""
WITH p AS (SELECT p_partkey, 'between ' || p_size || ' and ' || (p_size + 5) || CASE p_partkey % 3 WHEN 0 THEN ' million' WHEN 1 THEN '%' ELSE '' END AS t FROM part)
SELECT p_partkey, regexp_matches(t, '[0-9] and [0-9]') AND contains(t, 'between') AS is_range,
       round(regexp_extract(t, '([0-9]+)(?: million|%)?$', 1)::DOUBLE * CASE WHEN contains(t, 'million') THEN 1e6::DOUBLE WHEN contains(t, '%') THEN 0.01::DOUBLE ELSE 1::DOUBLE END, 4) AS upper_bound FROM p
""")
def t21_scaled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text states a range, and its last number with its scale applied."""
    unit = F.when(F.col("p_partkey") % 3 == 0, " million").when(F.col("p_partkey") % 3 == 1, "%").otherwise("")
    t = F.concat(F.lit("between "), "p_size", F.lit(" and "), F.col("p_size") + 5, unit)
    scale = F.when(F.contains(t, F.lit("million")), 1e6).when(F.contains(t, F.lit("%")), 0.01).otherwise(1.0)
    value = F.regexp_extract(t, "([0-9]+)(?: million|%)?$", 1).cast("double") * scale
    return table(spark, sf_dir, "part").select("p_partkey", (t.rlike("[0-9] and [0-9]") & F.contains(t, F.lit("between"))).alias("is_range"), F.round(value, 4).alias("upper_bound"))


def word_diff(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, position, kind (equal, replace, delete, insert), old and new words of each difference, by longest matching blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, old, new in zip(frame[key], frame[before], frame[after], strict=True):
                a, b = (old or "").split(), (new or "").split()
                ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
                out += [(k, n, kind, " ".join(a[i:j]), " ".join(b[p:q])) for n, (kind, i, j, p, q) in enumerate(ops)]
            yield pd.DataFrame(out, columns=[key, "position", "kind", "old", "new"])

    return rows.select(key, before, after).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, position int, kind string, old string, new string")


@query()
def t24_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word differences of each passage from a revision of it; SQL has no longest common blocks."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.regexp_replace("text", r"\bthe\b", "that").alias("revised"))
    return word_diff(rows, "item_id", "text", "revised")


@query(r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text || ' 12 new 7', '[0-9]+') AS a, text, text || ' 12 new 7' AS b FROM documents)
SELECT doc_id, length(b) - length(text) AS grown, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '\|')) AS pipes, len(regexp_extract_all(text, '(^|\n)#')) AS headings FROM p
""")
def t24_structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a revision's length differs, and the lines, pipes and headings of the text."""
    text = F.col("text")
    revised = F.concat(text, F.lit(" 12 new 7"))
    long = lambda c, n: c.cast("long").alias(n)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        long(F.length(revised) - F.length(text), "grown"),
        long(F.size(F.split(text, "\n", -1)), "lines"),
        long(F.regexp_count(text, F.lit(r"\|")), "pipes"),
        long(F.regexp_count(text, F.lit(r"(^|\n)#")), "headings"),
    )


def grounded_lines(rows: DataFrame, key: str, reply: Column, context: Column) -> DataFrame:
    """Lines of each reply with offsets, grounded if the context holds most of their words.

    At least 70 % of the words longer than three characters where there are
    four, else half of those longer than two where there are two.
    """
    lines = F.split(reply, "\n", -1)
    each = rows.select(key, context.alias("context"), lines.alias("lines"), F.posexplode(lines).alias("position", "line"))
    start = F.aggregate(F.slice("lines", F.lit(1), F.col("position")), F.lit(0), lambda s, x: s + F.length(x) + 1)
    words = F.array_distinct(X.words(F.col("line")))
    long, short = F.filter(words, lambda w: F.length(w) > 3), F.filter(words, lambda w: F.length(w) > 2)
    hits = lambda ws: F.size(F.filter(ws, lambda w: F.contains(F.lower("context"), w)))
    grounded = F.when(F.size(long) >= 4, hits(long) / F.size(long) >= 0.7).when(F.size(short) >= 2, hits(short) / F.size(short) >= 0.5).otherwise(F.lit(False))
    return each.select(key, "position", start.alias("start"), (start + F.length("line")).alias("end"), grounded.alias("grounded"))


@query(rf"""
WITH p AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls, lower(text2) AS ctx FROM (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS text2, role FROM conversations) WHERE role <> 'user'),
e AS (SELECT conv_id || '-' || turn AS reply, ctx, ls, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM p),
w AS (SELECT *, list_distinct({sql.words("line")}) AS ws FROM e),
f AS (SELECT *, list_filter(ws, lambda x: length(x) > 3) AS lw, list_filter(ws, lambda x: length(x) > 2) AS sw FROM w)
SELECT reply, pos::INT AS position, coalesce(list_sum(list_transform(ls[1:pos], lambda x: length(x) + 1)), 0)::INT AS start, (coalesce(list_sum(list_transform(ls[1:pos], lambda x: length(x) + 1)), 0) + length(line))::INT AS "end",
  CASE WHEN len(lw) >= 4 THEN len(list_filter(lw, lambda x: contains(ctx, x)))::DOUBLE / len(lw) >= 0.7 WHEN len(sw) >= 2 THEN len(list_filter(sw, lambda x: contains(ctx, x)))::DOUBLE / len(sw) >= 0.5 ELSE false END AS grounded FROM f
""")
def t28_grounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.lag("text").over(order), F.lit(""))).where("role <> 'user'")
    return grounded_lines(rows.withColumn("reply", F.concat_ws("-", "conv_id", "turn")), "reply", F.col("text"), F.col("before"))


def attach_citations(drafts: DataFrame, key: str, text: str, sentences: DataFrame) -> DataFrame:
    """key, sid and quote of the sentences that a draft cites as ``[S<n>]``; sentences that order the reader and unknown marks go.

    sentences: sid (a number) and sentence.
    """
    cited = drafts.select(key, F.explode(F.array_distinct(X.all_matches(F.col(text), r"\[S([0-9]+)\]", 1))).alias("sid"))
    fit = sentences.where(X.trust(F.col("sentence")) == "trusted").select(F.col("sid").cast("string").alias("sid"), F.substring("sentence", 1, 280).alias("quote"))
    return cited.join(fit, "sid").select(key, F.col("sid").cast("long").alias("sid"), "quote")


@query(rf"""
WITH d AS (SELECT conv_id || '-' || turn AS draft, list_distinct(regexp_extract_all(text || ' [S' || conv_id % 50 || '][S' || (conv_id + 1) % 50 || '] [S' || conv_id % 50 || ']', '\[S([0-9]+)\]', 1)) AS c FROM conversations)
SELECT draft, sid::BIGINT AS sid, left(text, 280) AS quote FROM (SELECT draft, unnest(c) AS sid FROM d) JOIN benchmark ON item_id = sid::BIGINT WHERE NOT regexp_matches(lower(text), '{"|".join(X.INSTRUCTIONS)}')
""")
def v2_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    text = F.concat("text", F.lit(" [S"), k % 50, F.lit("][S"), (k + 1) % 50, F.lit("] [S"), k % 50, F.lit("]"))
    drafts = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("draft"), text.alias("text"))
    return attach_citations(drafts, "draft", "text", table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sid"), F.col("text").alias("sentence")))


def confidence_spans(rows: DataFrame, key: str, text: str, violations: Column) -> DataFrame:
    """Sentence units of each text with offsets, and 0.25 where a violated key stands in them, else 0.85."""
    units = F.regexp_extract_all(F.col(text), F.lit(r"[^.!?]+[.!?]|[^.!?]+$"), F.lit(0))
    ends = F.aggregate(units, F.array(F.lit(0)), lambda s, u: F.array_append(s, F.element_at(s, -1) + F.length(u)))
    each = rows.select(key, violations.alias("violations"), ends.alias("ends"), F.posexplode(units).alias("position", "unit"))
    bad = F.exists("violations", lambda v: F.contains(F.lower("unit"), F.lower(v)))
    return each.select(key, "position", F.get("ends", F.col("position")).alias("start"), F.get("ends", F.col("position") + 1).alias("end"), F.when(bad, 0.25).otherwise(0.85).alias("confidence"))


@query()
def v12_confidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the passages; runs of marks make offsets that SQL's splitters cannot follow."""
    return confidence_spans(table(spark, sf_dir, "benchmark"), "item_id", "text", F.array(F.lit("the"), F.lit("License")))


@query("""
SELECT p_partkey AS node, CASE WHEN l.n IS NOT NULL THEN 'number' WHEN contains(lower(p_name), 'green') THEN 'key' ELSE 'none' END AS rule FROM part LEFT JOIN (SELECT DISTINCT n_nationkey AS n FROM nation) l ON l.n = p_size
""")
def v13_rules_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locked fact that explains a node: by its number, else by its key, else none."""
    locks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p_size")).distinct().withColumn("hit", F.lit(True))
    rule = F.when(F.col("hit"), "number").when(F.contains(F.lower("p_name"), F.lit("green")), "key").otherwise("none")
    return table(spark, sf_dir, "part").join(locks, "p_size", "left").select(F.col("p_partkey").alias("node"), rule.alias("rule"))


@query("""
WITH v AS (SELECT o_custkey AS document, o_orderkey AS revision, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders),
n AS (SELECT document, version, l_linenumber AS node, md5(l_returnflag || '|' || l_linestatus) AS h FROM v JOIN lineitem ON l_orderkey = revision),
p AS (SELECT document, max(version) AS cur FROM n GROUP BY 1)
SELECT coalesce(a.document, b.document) AS document, coalesce(a.node, b.node) AS node, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM
  (SELECT n.document, node, min(h) AS h FROM n JOIN p ON n.document = p.document AND version = cur GROUP BY 1, 2) a FULL JOIN
  (SELECT n.document, node, min(h) AS h FROM n JOIN p ON n.document = p.document AND version = cur - 1 GROUP BY 1, 2) b ON a.document = b.document AND a.node = b.node WHERE a.h IS DISTINCT FROM b.h
""")
def v17_tree_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that the newest revision of each document added, removed or changed, by digest.

    The two newest versions are told apart by a flag and compared in one
    aggregation, so no version meets another in a join.
    """
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("node"), F.md5(F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("h"))
    versions = table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(order)).select(F.col("o_custkey").alias("document"), "o_orderkey", "version")
    nodes = versions.join(lines, "o_orderkey")
    newest = nodes.groupBy("document").agg(F.max("version").alias("cur"))
    both = nodes.join(newest, "document").where("version >= cur - 1").withColumn("new", F.col("version") == F.col("cur"))
    sides = both.groupBy("document", "node").agg(F.min(F.when(F.col("new"), F.col("h"))).alias("a"), F.min(F.when(~F.col("new"), F.col("h"))).alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return sides.select("document", "node", change.alias("change")).where("change IS NOT NULL")


@query("""
SELECT l_orderkey AS node, l_linenumber AS finding, CASE WHEN l_returnflag = 'R' THEN 'resolved' WHEN l_returnflag = 'A' THEN 'dismissed' ELSE 'open' END AS status,
       CASE WHEN l_returnflag = 'R' THEN o_orderkey END AS resolved_by, CASE WHEN l_returnflag = 'R' THEN o_orderdate END AS resolved_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def v19_finding_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after a rewrite of their node: open ones it answers are resolved, with the revision that did."""
    answered = F.col("l_returnflag") == "R"
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    status = F.when(answered, "resolved").when(F.col("l_returnflag") == "A", "dismissed").otherwise("open")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("finding"), status.alias("status"), F.when(answered, F.col("o_orderkey")).alias("resolved_by"), F.when(answered, F.col("o_orderdate")).alias("resolved_at")
    )


@query("""
SELECT l_orderkey AS node, cited, coalesce(page, number) AS page FROM (SELECT l_orderkey, coalesce(nullif(l_returnflag, 'N'), 's' || l_suppkey % 7) AS cited, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS page, l_partkey AS number, l_linenumber FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_orderkey, cited ORDER BY l_linenumber, number, coalesce(page, number)) = 1
""")
def v29_export_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's citations for export, one for each cited source, with the page or else the page number."""
    cited = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.concat(F.lit("s"), F.col("l_suppkey") % 7))
    page = F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")), F.col("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), cited.alias("cited"), F.struct("l_linenumber", "l_partkey", page.alias("page")).alias("r"))
    return rows.groupBy("node", "cited").agg(F.min("r").alias("r")).select("node", "cited", F.col("r.page").alias("page"))


@query("""
WITH p AS (SELECT s_suppkey AS document, unnest(range(1, 4))::INT AS page FROM supplier), c AS (SELECT s_suppkey AS document, s_name AS content, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 4)::INT END AS page FROM supplier)
SELECT p.document, p.page, coalesce(content, '(Empty page ' || p.page || ')') AS content FROM p LEFT JOIN c ON c.document = p.document AND (c.page IS NULL OR c.page = p.page)
""")
def v30_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each page: its chunks, chunks without a page on every one, or a note that it is empty."""
    suppliers = table(spark, sf_dir, "supplier")
    pages = suppliers.select(F.col("s_suppkey").alias("document"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    own = F.when(F.col("s_suppkey") % 4 > 0, F.array((F.col("s_suppkey") % 4).cast("int"))).otherwise(F.sequence(F.lit(1), F.lit(3)))
    chunks = suppliers.select(F.col("s_suppkey").alias("document"), F.explode(own).alias("page"), F.col("s_name").alias("content"))
    empty = F.concat(F.lit("(Empty page "), "page", F.lit(")"))
    return pages.join(chunks, ["document", "page"], "left").select("document", "page", F.coalesce("content", empty).alias("content"))


@query("""
SELECT event_id, user_id, ok FROM (SELECT event_id, user_id, value > 5 AND relation <> 'error' AND user_id % 13 <> 0 AS ok FROM (SELECT *, event_type AS relation FROM events))
""")
def v28_valid_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as translated to JSON: one bad operand, or an unknown relation, rejects the whole claim."""
    operand = lambda v: F.struct(F.lit("x").alias("name"), v.cast("string").alias("value"))
    second = F.when(F.col("user_id") % 13 == 0, F.lit("n/a")).otherwise(F.lit("1"))
    payload = F.to_json(F.struct(F.col("event_type").alias("relation"), F.array(operand(F.col("value")), operand(second)).alias("operands")))
    parsed = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json(payload, "relation string, operands array<struct<name:string,value:string>>").alias("c"))
    good = F.forall("c.operands", lambda o: o["value"].rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:E-?[0-9]+)?$")) & (F.get("c.operands", F.lit(0))["value"].cast("double") > 5)
    return parsed.select("event_id", "user_id", (good & (F.col("c.relation") != "error")).alias("ok"))


@query("""
WITH f AS (SELECT l_orderkey AS node, l_returnflag AS message, 0 AS priority, l_linenumber AS place FROM lineitem WHERE l_linenumber <= 2
  UNION ALL SELECT l_orderkey, l_returnflag, 1, l_linenumber FROM lineitem WHERE l_linenumber > 2 UNION ALL SELECT o_orderkey, 'X', 2, 0 FROM orders WHERE o_orderstatus = 'P')
SELECT node, message, priority FROM f QUALIFY row_number() OVER (PARTITION BY node, message ORDER BY priority, place) = 1
""")
def u8_findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the tree, of runs and of past revisions, the first source's of each node and message."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_returnflag").alias("message"), F.when(F.col("l_linenumber") <= 2, 0).otherwise(1).alias("priority"))
    past = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"), F.lit("X").alias("message"), F.lit(2).alias("priority"))
    return lines.unionByName(past).groupBy("node", "message").agg(F.min("priority").alias("priority"))


@query("""
WITH l AS (SELECT o_orderkey AS run, o_orderdate AS since, unnest([o_custkey, o_custkey % 100]) AS lock FROM orders)
SELECT sha256(lock::VARCHAR)[1:16] AS lock_hash, lock, run FROM l QUALIFY row_number() OVER (PARTITION BY lock ORDER BY since, run) = 1
""")
def u9_lock_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locks of all runs, each with the first run that has it."""
    locks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at"), F.explode(F.array("o_custkey", F.col("o_custkey") % 100)).alias("lock"))
    first = locks.groupBy("lock").agg(F.min_by("run", F.struct("at", "run")).alias("run"))
    return first.select(F.substring(F.sha2(F.col("lock").cast("string"), 256), 1, 16).alias("lock_hash"), "lock", "run")


@query("""
SELECT l_orderkey AS document, count(*) AS findings, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS open, count(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 END) AS resolved,
       count(CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 1 END) AS dismissed, count(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_tax > 0.04 THEN 1 END) AS remediated_unsupported,
       count(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_discount = 0 THEN 1 END) AS remediated_unanchored FROM lineitem GROUP BY 1
""")
def a9_finding_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each document by state, and what resolved ones answered."""
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    done, flag = F.col("l_linestatus") == "F", F.col("l_returnflag")
    resolved = done & (flag == "R")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document")).agg(
        F.count("*").alias("findings"),
        count(~done, "open"),
        count(resolved, "resolved"),
        count(done & (flag != "R"), "dismissed"),
        count(resolved & (F.col("l_tax") > 0.04), "remediated_unsupported"),
        count(resolved & (F.col("l_discount") == 0), "remediated_unanchored"),
    )


@query(f"SELECT doc_id, len({sql.content_words('text')}) >= 4 AS eligible FROM documents")
def p8_eligible_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a paragraph is a claim: at least four distinct content words."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(X.content_words(F.col("text"))) >= 4).alias("eligible"))


def year_conflicts(orders: DataFrame) -> DataFrame:
    """Runs whose years disagree, by classes of runs with the same years: a year set is one of few, so pairs are few."""
    years = orders.groupBy(F.col("o_custkey").alias("run")).agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"))
    classes = years.groupBy("years").agg(F.min("run").alias("run"), F.count("*").alias("runs")).withColumn("all", F.lit(1))
    a = classes.select("all", F.col("years").alias("ya"), F.col("run").alias("run_a"), F.col("runs").alias("runs_a"))
    b = classes.select("all", F.col("years").alias("yb"), F.col("run").alias("run_b"), F.col("runs").alias("runs_b"))
    pairs = a.join(b, "all").where("run_a < run_b AND size(array_except(ya, yb)) > 0 AND size(array_except(yb, ya)) > 0")
    return pairs.select("run_a", "run_b", "runs_a", "runs_b")


YEARS_SQL = """
WITH y AS (SELECT o_custkey AS run, list_sort(list_distinct(list(year(o_orderdate)::INT))) AS years FROM orders GROUP BY 1), c AS (SELECT years, min(run) AS run, count(*) AS runs FROM y GROUP BY 1)
SELECT a.run AS run_a, b.run AS run_b, a.runs AS runs_a, b.runs AS runs_b FROM c a JOIN c b ON a.run < b.run WHERE len(list_filter(a.years, lambda x: NOT list_contains(b.years, x))) > 0 AND len(list_filter(b.years, lambda x: NOT list_contains(a.years, x))) > 0
"""


@query(YEARS_SQL)
def j9_year_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year conflicts of all runs."""
    return year_conflicts(table(spark, sf_dir, "orders"))


@query(YEARS_SQL)
def j9_all_year_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its second name."""
    return j9_year_conflicts(spark, sf_dir)
