"""Checks of parsed tables, prompts, edits and locks, and exports of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.registry import query
from tessera.sources.tables import table

NUMBER = "[0-9]+(?:[,.][0-9]+)*"


def table_grid(cells: DataFrame, key: str) -> DataFrame:
    """key and grid, an array of rows of texts; cells that share a place are joined by a space, places without one are empty.

    cells: grid_row and grid_col from 0, place (their order) and text.
    """
    at = cells.groupBy(key, "grid_row", "grid_col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), " ").alias("text"))
    entry = F.struct(F.struct("grid_row", "grid_col").alias("key"), F.col("text").alias("value"))
    whole = at.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("cells"), F.max("grid_row").alias("last_row"), F.max("grid_col").alias("last_col"))
    line = lambda r: F.transform(F.sequence(F.lit(0), "last_col"), lambda c: F.coalesce(F.col("cells")[F.struct(r.alias("grid_row"), c.alias("grid_col"))], F.lit("")))
    return whole.select(key, F.transform(F.sequence(F.lit(0), "last_row"), line).alias("grid"))


@query("""
WITH c AS (SELECT l_orderkey AS t, l_linenumber % 3 AS r, l_suppkey % 2 AS c, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS txt FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT t, max(r) AS mr, max(c) AS mc FROM c GROUP BY 1), g AS (SELECT t, r, unnest(range(0, mc + 1)) AS c FROM (SELECT t, mc, unnest(range(0, mr + 1)) AS r FROM d))
SELECT g.t AS document, g.r::INT AS grid_row, g.c::INT AS grid_col, coalesce(txt, '') AS text FROM g LEFT JOIN c ON c.t = g.t AND c.r = g.r AND c.c = g.c
""")
def s9_table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised cells put together to tables, read back cell by cell."""
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"), (F.col("l_linenumber") % 3).cast("int").alias("grid_row"), (F.col("l_suppkey") % 2).cast("int").alias("grid_col"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("text")
    )
    rows = table_grid(cells, "document").select("document", F.posexplode("grid").alias("grid_row", "line"))
    return rows.select("document", "grid_row", F.posexplode("line").alias("grid_col", "text"))


def tag_errors(prompt: Column, required: list[str], optional: list[str]) -> Column:
    """What is wrong with a prompt's tags: required ones that are missing, and any that open and close unequally often."""

    def errors(name: str, needed: bool) -> Column:
        opens = F.regexp_count(prompt, F.lit(rf"(?mi)^[ \t]*<{name}>"))
        closes = F.regexp_count(prompt, F.lit(rf"(?mi)^[ \t]*</{name}>"))
        uneven = F.when((opens > 0) & (opens != closes), F.lit(f"{name} is unbalanced"))
        return F.when(opens == 0, F.lit(f"{name} is missing")).otherwise(uneven) if needed else uneven

    found = F.array_compact(F.array(*[errors(n, True) for n in required], *[errors(n, False) for n in optional]))
    return F.when(F.trim(prompt) == "", F.array(F.lit("empty"))).otherwise(found)


@query(r"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN '<Role>' || chr(10) || p_name || chr(10) || '</role>' || chr(10) ELSE '' END || ' <instructions>' || chr(10) || p_brand || chr(10) ||
  CASE WHEN p_size % 3 > 0 THEN '</instructions>' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN chr(10) || '<context>' ELSE '' END AS t FROM part),
c AS (SELECT p_partkey, len(regexp_extract_all(t, '(?mi)^[ \t]*<role>')) AS ro, len(regexp_extract_all(t, '(?mi)^[ \t]*</role>')) AS rc, len(regexp_extract_all(t, '(?mi)^[ \t]*<instructions>')) AS io,
  len(regexp_extract_all(t, '(?mi)^[ \t]*</instructions>')) AS ic, len(regexp_extract_all(t, '(?mi)^[ \t]*<context>')) AS xo, len(regexp_extract_all(t, '(?mi)^[ \t]*</context>')) AS xc FROM p)
SELECT p_partkey, concat_ws('; ', CASE WHEN ro = 0 THEN 'role is missing' WHEN ro <> rc THEN 'role is unbalanced' END, CASE WHEN io = 0 THEN 'instructions is missing' WHEN io <> ic THEN 'instructions is unbalanced' END,
  CASE WHEN xo > 0 AND xo <> xc THEN 'context is unbalanced' END) AS errors FROM c
""")
def t30_tag_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    role = F.when(key % 11 > 0, F.concat(F.lit("<Role>\n"), "p_name", F.lit("\n</role>\n"))).otherwise("")
    prompt = F.concat(role, F.lit(" <instructions>\n"), "p_brand", F.lit("\n"), F.when(size % 3 > 0, "</instructions>").otherwise(""), F.when(size % 5 == 0, "\n<context>").otherwise(""))
    prompts = table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))
    return prompts.select("p_partkey", F.array_join(tag_errors(F.col("prompt"), ["role", "instructions"], ["thinking", "context"]), "; ").alias("errors"))


@query("""
SELECT p_partkey, sha256('{"metric":"' || p_name || '","value":' || p_size || '}') AS lock_digest, sha256('{"metric":"' || p_name || '","value":' || p_size || '}')[1:16] AS lock_hash FROM part
""")
def t31_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of facts as JSON with their keys in order, and the short form that names a lock."""
    digest = F.sha2(F.to_json(F.struct(F.col("p_name").alias("metric"), F.col("p_size").alias("value"))), 256)
    return table(spark, sf_dir, "part").select("p_partkey", digest.alias("lock_digest"), F.substring(digest, 1, 16).alias("lock_hash"))


@query("""
SELECT o_custkey AS project, o_orderkey AS revision, count(l_orderkey) + 1 AS node_count, count(CASE WHEN l_returnflag = 'R' THEN 1 END) + count(CASE WHEN l_tax > 0.04 THEN 1 END) AS findings
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def a22_revision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each revision, its section included, and the findings that are noted at them."""
    noted = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "claim"), F.when(F.col("l_tax") > 0.04, "figure")))
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("revision"), F.size(noted).alias("n"))
    per_revision = nodes.groupBy("revision").agg(F.count("*").alias("nodes"), F.sum("n").alias("n"))
    revisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("revision"))
    return revisions.join(per_revision, "revision", "left").select("project", "revision", (F.coalesce("nodes", F.lit(0)) + 1).alias("node_count"), F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


@query("""
WITH c AS (SELECT o_custkey AS document, o_orderkey AS node, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS own FROM orders),
f AS (SELECT document, min(node) AS first_node, arg_min(own, node) FILTER (own IS NOT NULL) AS first_own FROM c GROUP BY 1)
SELECT c.node, l_linenumber AS unit, CASE WHEN l_linenumber % 2 = 0 THEN max(l_discount) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) END AS score, coalesce(own, CASE WHEN c.node = first_node THEN first_own END) AS critique FROM c JOIN f USING (document) JOIN lineitem ON l_orderkey = c.node
""")
def j21_claim_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the score of the span at their place and their node's critique; a document's first node may take its first critique."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("unit"), F.col("l_partkey").alias("end"), F.col("l_discount").alias("score"))
    spans = lines.where("unit % 2 = 0").groupBy("node", "unit", "end").agg(F.max("score").alias("score"))
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("own"))
    first = nodes.groupBy("document").agg(F.min("node").alias("first_node"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("node"))).alias("first_own"))
    critique = F.coalesce("own", F.when(F.col("node") == F.col("first_node"), F.col("first_own")))
    said = nodes.join(first, "document").select("node", critique.alias("critique"))
    return lines.drop("score").join(spans, ["node", "unit", "end"], "left").join(said, "node").select("node", "unit", "score", "critique")


@query(r"""
WITH s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS src FROM conversations WHERE role <> 'user' AND trim(text) <> '' GROUP BY 1),
w AS (SELECT conv_id, turn, trim(text) AS claim, lower(src) AS src, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: length(x) > 3) AS ws FROM conversations JOIN s USING (conv_id) WHERE role = 'user' AND trim(text) <> ''),
h AS (SELECT *, len(list_filter(ws, lambda x: contains(src, x)))::DOUBLE / len(ws) AS score FROM w WHERE len(ws) > 0)
SELECT conv_id, turn, left(claim, 64) AS canonical_key, round(score, 6) AS confidence FROM h WHERE score >= 0.4
""")
def v10_claim_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks of the claims that their sources, put together in order, carry; other claims lock nothing."""
    turns = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    sources = turns.where("role <> 'user'").groupBy("conv_id").agg(F.lower(F.array_join(ordered, "\n\n")).alias("src"))
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 3)
    claims = turns.where("role = 'user'").select("conv_id", "turn", F.substring(F.trim("text"), 1, 64).alias("canonical_key"), words.alias("ws")).where("size(ws) > 0")
    score = F.size(F.filter("ws", lambda w: F.contains(F.col("src"), w))) / F.size("ws")
    return claims.join(sources, "conv_id").withColumn("score", score).where("score >= 0.4").select("conv_id", "turn", "canonical_key", F.round("score", 6).alias("confidence"))


def lost_numbers(paragraphs: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """The keys of paragraphs of which a number stands less often after an edit than before, with how many such numbers."""
    sides = paragraphs.select(key, F.explode(F.array(F.struct(F.lit(1).alias("side"), before.alias("t")), F.struct(F.lit(-1).alias("side"), after.alias("t")))).alias("s"))
    each = sides.select(key, "s.side", F.explode(X.all_matches(F.col("s.t"), NUMBER)).alias("number"))
    return each.groupBy(key, "number").agg(F.sum("side").alias("missing")).where("missing > 0").groupBy(key).agg(F.count("*").alias("lost"))


@query(f"""
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{NUMBER}')) AS number, 1 AS side FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(CASE WHEN doc_id % 4 = 0 THEN replace(text, '7', '8') ELSE text END, '{NUMBER}')), -1 FROM documents),
l AS (SELECT doc_id FROM (SELECT doc_id, number FROM n GROUP BY 1, 2 HAVING sum(side) > 0) GROUP BY 1)
SELECT source, count(*) AS paragraphs, count(l.doc_id) AS changed, count(l.doc_id) = 0 AS preserved FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY 1
""")
def v23_numbers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an edit kept every figure of every paragraph; a source stands for a document here."""
    docs = table(spark, sf_dir, "documents")
    edited = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("7"), F.lit("8"))).otherwise(F.col("text"))
    lost = lost_numbers(docs, "doc_id", F.col("text"), edited)
    both = docs.select("doc_id", "source").join(lost, "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("paragraphs"), F.count("lost").alias("changed"), (F.count("lost") == 0).alias("preserved"))


@query("""
SELECT o_orderkey AS document, sha256('# ' || o_orderpriority || chr(10) || chr(10) || string_agg(l_returnflag || l_linestatus, chr(10) || chr(10) ORDER BY l_linenumber, l_returnflag || l_linestatus)) AS markdown FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority
""")
def k8_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: the title, then the paragraphs in order; here their digests."""
    paragraph = F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("content"))
    bodies = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document")).agg(F.array_sort(F.collect_list(paragraph)).alias("p"))
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), F.concat(F.lit("# "), "o_orderpriority").alias("title"))
    text = F.array_join(F.array_prepend(F.transform("p", lambda s: s["content"]), F.col("title")), "\n\n")
    return bodies.join(titles, "document").select("document", F.sha2(text, 256).alias("markdown"))
