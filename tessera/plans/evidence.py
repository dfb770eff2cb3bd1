"""Evidence verdicts: the best excerpt of a claim's sources, and what it says about the claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.functions import text as X
from tessera.operators.windows import PER_FILE_CHARS, TOTAL_CHARS, source_budget
from tessera.registry import query
from tessera.sources.tables import table

SUPPORTED, NUMBERS, PARTIAL = 0.7, 0.8, 0.4


def excerpts(sources: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """The sources' texts as far as the budget carries them, in order of ``key``, with their rank in the group and their trust.

    ``key`` tells the rows of a group apart. Every carried row takes a
    character at least, so only as many rows of a group as the budget has
    characters take part, cut before the shuffle; texts are fetched for
    carried rows.
    """
    order = [F.col(key)]
    trimmed = sources.withColumn("excerpt", F.trim(text)).where("excerpt <> ''")
    slim = trimmed.select(group, key, F.length("excerpt").alias("chars"))
    first = slim.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= TOTAL_CHARS).drop("nth")
    kept = source_budget(first, group, order, "chars", PER_FILE_CHARS, TOTAL_CHARS).where("carried > 0")
    ranked = kept.select(group, key, "carried", F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("rank"))
    carried = trimmed.join(ranked, [group, key])
    return carried.withColumn("excerpt", F.col("excerpt").substr(F.lit(1), F.col("carried").cast("int"))).withColumn("trust", X.trust(F.col("excerpt")))


def verdict(claim: Column, excerpt: Column) -> Column:
    """contradicted, supported, partial or not_supported by one excerpt; unverified for claims without long words."""
    long_words = F.filter(F.split(F.lower(claim), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 3)
    own, other = X.signed_numbers(claim), X.signed_numbers(excerpt)
    numbers = F.when(F.size(own) > 0, F.size(F.array_intersect(own, other)) / F.size(own)).otherwise(F.lit(1.0))
    ratio = X.weighted_match(claim, excerpt)
    return (
        F.when(F.size(long_words) == 0, "unverified")
        .when(X.opposes(claim, excerpt), "contradicted")
        .when((ratio >= SUPPORTED) & (numbers >= NUMBERS), "supported")
        .when(ratio >= PARTIAL, "partial")
        .otherwise("not_supported")
    )


def judge(claims: DataFrame, kept: DataFrame, group: str, source: str) -> DataFrame:
    """Each claim's verdict by the excerpt of its group that overlaps it most; unanchored where the group has none.

    A group's excerpts are few, by the budget, so a claim meets a bounded number of them.
    """
    met = claims.join(kept.select(group, source, "rank", "excerpt", "trust"), group).withColumn("percent", X.boosted_overlap(F.col("claim"), F.col("excerpt")))
    order = F.struct((-F.col("percent")).alias("p"), F.when(F.col("percent") > 0, F.lit(0)).otherwise(F.col("rank")).alias("r"), F.col(source).alias("s"))
    best = met.groupBy("claim_id", "claim").agg(F.min_by(F.struct(source, "excerpt", "trust", "percent"), order).alias("b"), F.count(F.when(F.col("percent") > 0, 1)).alias("candidates"))
    judged = best.select("claim_id", F.col(f"b.{source}").alias("source_id"), F.col("b.trust").alias("trust"), F.round("b.percent", 6).alias("percent"), "candidates", verdict(F.col("claim"), F.col("b.excerpt")).alias("verdict"))
    return claims.select("claim_id").join(judged, "claim_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unanchored")))


_VERDICT_SQL = rf"""CASE WHEN len(list_filter(string_split_regex(lower(claim), '[\x20\x09-\x0D]+'), lambda w: length(w) > 3)) = 0 THEN 'unverified'
  WHEN {sql.opposes("claim", "excerpt")} THEN 'contradicted'
  WHEN {sql.weighted_match("claim", "excerpt")} >= 0.7 AND (CASE WHEN len({sql.signed_numbers("claim")}) > 0 THEN len(list_intersect(list_distinct({sql.signed_numbers("claim")}), list_distinct({sql.signed_numbers("excerpt")})))::DOUBLE / len({sql.signed_numbers("claim")}) ELSE 1.0::DOUBLE END) >= 0.8 THEN 'supported'
  WHEN {sql.weighted_match("claim", "excerpt")} >= 0.4 THEN 'partial' ELSE 'not_supported' END"""


def passage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the benchmark's passages by the documents of a source; five of 25 sources have none."""
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.concat(F.lit("src"), F.col("item_id") % 25).alias("source"), F.col("text").alias("claim"))
    kept = excerpts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text")
    return judge(claims, kept, "source", "doc_id")


WHOLE_SQL = rf"""
WITH x AS (SELECT doc_id, source, text AS full_text, trim(text) AS t, length(trim(text)) AS chars FROM documents WHERE length(trim(text)) > 0),
b AS (SELECT *, row_number() OVER w AS rk, greatest(0, least(least(chars, 4000), 16000 - coalesce(sum(least(chars, 4000)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INT AS carried FROM x WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
k AS (SELECT source, doc_id, rk, left(t, carried) AS excerpt FROM b WHERE carried > 0),
c AS (SELECT item_id AS claim_id, 'src' || item_id % 25 AS source, text AS claim FROM benchmark),
m AS (SELECT claim_id, claim, doc_id, rk, excerpt, {sql.boosted_overlap("claim", "excerpt")} AS percent FROM c JOIN k USING (source)),
n AS (SELECT *, count(CASE WHEN percent > 0 THEN 1 END) OVER (PARTITION BY claim_id) AS candidates FROM m QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY percent DESC, CASE WHEN percent > 0 THEN 0 ELSE rk END, doc_id) = 1)
SELECT c.claim_id, n.doc_id AS source_id, CASE WHEN n.excerpt IS NULL THEN NULL WHEN regexp_matches(lower(n.excerpt), '{"|".join(X.INSTRUCTIONS)}') THEN 'untrusted' ELSE 'trusted' END AS trust, round(percent, 6) AS percent, candidates,
  CASE WHEN n.claim_id IS NULL THEN 'unanchored' ELSE v END AS verdict FROM c LEFT JOIN (SELECT *, {_VERDICT_SQL} AS v FROM n) n ON n.claim_id = c.claim_id
"""


@query(WHOLE_SQL)
def v3_evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of whole passages."""
    return passage_verdicts(spark, sf_dir)


@query(WHOLE_SQL)
def v3_whole_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its second name."""
    return v3_evidence_verdict(spark, sf_dir)


@query(rf"""
WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS claim, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS src, role FROM conversations),
w AS (SELECT conv_id, turn, src, list_filter(string_split_regex(lower(claim), '[\x20\x09-\x0D]+'), lambda x: length(x) > 3) AS ws FROM p WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: contains(lower(src), x)))::DOUBLE / len(ws), 6) ELSE 0.0::DOUBLE END AS score,
       CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: contains(lower(src), x)))::DOUBLE / len(ws) >= 0.4 ELSE false END AS grounded,
       len(ws) - len(list_filter(ws, lambda x: contains(lower(src), x))) <= greatest(1, len(ws) // 3) AS few_missing FROM w
""")
def v9_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a claim's long words that stand anywhere in the source: grounded from 0.4; and whether few are missing."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("claim"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("src")).where("role = 'user'")
    ws = F.filter(F.split(F.lower("claim"), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 3)
    found = rows.select("conv_id", "turn", F.size(ws).alias("n"), F.size(F.filter(ws, lambda w: F.contains(F.lower("src"), w))).alias("hits"))
    score = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(0.0))
    return found.select("conv_id", "turn", F.round(score, 6).alias("score"), (score >= 0.4).alias("grounded"), (F.col("n") - F.col("hits") <= F.greatest(F.lit(1), F.floor(F.col("n") / 3))).alias("few_missing"))


def rolled_up(verdicts: Column, total: Column) -> tuple[Column, Column]:
    """A paragraph's verdict from how many citations say yes, no and partial, and whether any says no."""
    yes, no, partial = verdicts["yes"], verdicts["no"], verdicts["partial"]
    verdict_ = F.when(total == 0, "unverified").when(yes == total, "yes").when(no == total, "no").when((no > 0) | (yes + partial > 0), "partial").otherwise("unverified")
    return verdict_, no > 0


@query("""
WITH c AS (SELECT o_orderkey AS node, count(l_orderkey) AS n, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS yes, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS no, count(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 10 THEN 1 END) AS part
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 5 GROUP BY 1)
SELECT node, CASE WHEN n = 0 THEN 'unverified' WHEN yes = n THEN 'yes' WHEN no = n THEN 'no' WHEN no > 0 THEN 'partial' WHEN yes + part > 0 THEN 'partial' ELSE 'unverified' END AS verdict, no > 0 AS contradicted FROM c
""")
def v5_entailment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of citations rolled up to their paragraphs; a paragraph can be partly carried and contradicted."""
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    said = F.when(flag == "N", "yes").when(flag == "R", "no").when((F.col("l_linestatus") == "F") & (quantity > 10), "partial").otherwise("unverified")
    cited = table(spark, sf_dir, "lineitem").where(quantity > 5).select(F.col("l_orderkey").alias("node"), said.alias("said"))
    count = lambda v: F.count(F.when(F.col("said") == v, 1)).alias(v)
    counts = cited.groupBy("node").agg(F.count("*").alias("n"), F.struct(count("yes"), count("no"), count("partial")).alias("v"))
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")).join(counts, "node", "left")
    verdict_, contradicted = rolled_up(F.col("v"), F.coalesce("n", F.lit(0)))
    return nodes.select("node", verdict_.alias("verdict"), F.coalesce(contradicted, F.lit(False)).alias("contradicted"))


def provenance_counts(nodes: DataFrame, key: str) -> DataFrame:
    """Counters of each document's eligible paragraphs.

    nodes: eligible, anchored, verdict (yes, partial, no, unverified or null) and contradicted.
    Supported counts yes and partial. A paragraph that is contradicted counts as
    unsupported whatever else it is.
    """
    e = F.col("eligible")
    v = F.col("verdict")
    count = lambda c: F.count(F.when(e & c, 1))
    bad = F.coalesce(v == "no", F.lit(False)) | F.col("contradicted")
    return nodes.groupBy(key).agg(
        F.count(F.when(e, 1)).alias("eligible"),
        count(F.col("anchored")).alias("anchored"),
        count(~F.col("anchored")).alias("unanchored"),
        count(v.isin("yes", "partial")).alias("supported"),
        count(v == "partial").alias("partial"),
        count(bad).alias("unsupported"),
        count(~bad & (v == "unverified")).alias("unverified"),
        count(~bad & v.isNull() & F.col("anchored")).alias("unchecked"),
    )


def gate(status: Column, findings: Column, supported: Column) -> Column:
    """blocked for a violation, review for findings or nothing supported, else pass only for a passed check."""
    return F.when(supported == 0, "review").when(status == "VIOLATION", "blocked").when(findings > 0, "review").when(status == "PASS", "pass").otherwise("review")


@query("""
WITH n AS (SELECT l_orderkey AS document, l_quantity >= 5 AS e, l_discount > 0.02 AS a, CASE WHEN l_discount <= 0.02 OR l_quantity > 45 THEN NULL WHEN l_returnflag = 'N' THEN 'yes' WHEN l_returnflag = 'A' THEN 'partial' WHEN l_tax > 0.04 THEN 'no' ELSE 'unverified' END AS v, l_tax > 0.075 AS x FROM lineitem),
c AS (SELECT document, count(CASE WHEN e THEN 1 END) AS eligible, count(CASE WHEN e AND a THEN 1 END) AS anchored, count(CASE WHEN e AND NOT a THEN 1 END) AS unanchored, count(CASE WHEN e AND v IN ('yes', 'partial') THEN 1 END) AS supported,
  count(CASE WHEN e AND v = 'partial' THEN 1 END) AS partial, count(CASE WHEN e AND (coalesce(v = 'no', false) OR x) THEN 1 END) AS unsupported,
  count(CASE WHEN e AND NOT (coalesce(v = 'no', false) OR x) AND v = 'unverified' THEN 1 END) AS unverified, count(CASE WHEN e AND NOT x AND v IS NULL AND a THEN 1 END) AS unchecked FROM n GROUP BY 1)
SELECT c.*, CASE WHEN supported = 0 THEN 'review' WHEN o_orderstatus = 'P' THEN 'blocked' WHEN unsupported > 1 THEN 'review' WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'review' END AS gate FROM c JOIN orders ON o_orderkey = document
""")
def v6_provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and gate of each document."""
    r, q, d, t = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    v = F.when((d > 0.02) & (q <= 45), F.when(r == "N", "yes").when(r == "A", "partial").when(t > 0.04, "no").otherwise("unverified"))
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), (q >= 5).alias("eligible"), (d > 0.02).alias("anchored"), v.alias("verdict"), (t > 0.075).alias("contradicted"))
    status = F.when(F.col("o_orderstatus") == "P", "VIOLATION").when(F.col("o_orderstatus") == "F", "PASS").otherwise("SKIPPED")
    checks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), status.alias("status"))
    findings = F.when(F.col("unsupported") > 1, F.col("unsupported")).otherwise(0)
    return provenance_counts(nodes, "document").join(checks, "document").withColumn("gate", gate(F.col("status"), findings, F.col("supported"))).drop("status")
