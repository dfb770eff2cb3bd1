"""Confidence of nodes and documents, accuracy against labels, and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table

NEUTRAL = 60.0


def percent(confidence: Column) -> Column:
    """A confidence of 0..1 or 0..100 as 0..100; unknown stays null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(confidence <= 1.0, confidence * 100.0).otherwise(confidence)))


def node_score(parse: Column, ocr: Column, provenance: Column, entailment: Column, check: Column, findings: Column) -> Column:
    """Weighted score of a node, rounded half to even; unknown parse, OCR and check count as neutral."""
    known = lambda c: F.coalesce(c, F.lit(NEUTRAL))
    total = 0.25 * known(parse) + 0.10 * known(ocr) + 0.20 * provenance + 0.15 * entailment + 0.20 * known(check) + 0.10 * findings
    return F.bround(total, 0)


def band(score: Column) -> Column:
    return F.when(score >= 80, "supported").when(score >= 60, "partial").when(score >= 40, "not_supported").when(score >= 20, "contradicted").otherwise("unverified")


def entailment_score(verdict: Column) -> Column:
    return F.when(verdict == "supported", 100.0).when(verdict == "partial", 70.0).when(verdict == "not_supported", 30.0).when(verdict == "contradicted", 10.0).otherwise(0.0)


def findings_score(high: Column, medium: Column, low: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 35.0 * high - 15.0 * medium - 5.0 * low))


_NODES = """
n AS (SELECT l_orderkey AS document, l_linenumber AS node,
  CASE WHEN l_linenumber % 3 <> 0 THEN least(100.0::DOUBLE, l_quantity * 2) END AS parse, CASE WHEN l_linenumber % 2 = 0 THEN 100.0::DOUBLE * (l_discount * 10) END AS ocr,
  CASE WHEN l_tax > 0.02 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS prov, CASE l_returnflag WHEN 'N' THEN 100.0::DOUBLE WHEN 'A' THEN 70.0::DOUBLE ELSE 10.0::DOUBLE END AS ent,
  CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_discount > 0.08 THEN 20.0::DOUBLE ELSE 100.0::DOUBLE END AS chk, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - 35.0::DOUBLE * (l_linenumber % 2) - 15.0::DOUBLE * (l_linenumber % 3) - 5.0::DOUBLE * 1)) AS fnd FROM lineitem),
s AS (SELECT *, round_even(0.25::DOUBLE * coalesce(parse, 60) + 0.10::DOUBLE * coalesce(ocr, 60) + 0.20::DOUBLE * prov + 0.15::DOUBLE * ent + 0.20::DOUBLE * coalesce(chk, 60) + 0.10::DOUBLE * fnd, 0) AS score FROM n)"""


def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as nodes of documents, with signals of each."""
    n = F.col("l_linenumber")
    verdict = F.when(F.col("l_returnflag") == "N", "supported").when(F.col("l_returnflag") == "A", "partial").otherwise("contradicted")
    check = F.when(F.col("l_linestatus") != "O", F.when(F.col("l_discount") > 0.08, 20.0).otherwise(100.0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"),
        n.alias("node"),
        F.when(n % 3 != 0, F.least(F.lit(100.0), F.col("l_quantity") * 2)).alias("parse"),
        F.when(n % 2 == 0, F.lit(100.0) * (F.col("l_discount") * 10)).alias("ocr"),
        F.when(F.col("l_tax") > 0.02, 100.0).otherwise(0.0).alias("provenance"),
        entailment_score(verdict).alias("entailment"),
        check.alias("check"),
        findings_score(n % 2, n % 3, F.lit(1)).alias("findings"),
    ).withColumn("score", node_score(*[F.col(c) for c in ("parse", "ocr", "provenance", "entailment", "check", "findings")]))


@query(f"WITH {_NODES} SELECT document, node, score, CASE WHEN score >= 80 THEN 'supported' WHEN score >= 60 THEN 'partial' WHEN score >= 40 THEN 'not_supported' WHEN score >= 20 THEN 'contradicted' ELSE 'unverified' END AS verdict FROM s")
def c_node_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_nodes(spark, sf_dir).select("document", "node", "score", band(F.col("score")).alias("verdict"))


@query(f"""
WITH {_NODES}, d AS (SELECT document, avg(parse) AS parse, 40.0::DOUBLE + 20.0::DOUBLE * (CASE WHEN max(node) >= 3 THEN 1 ELSE 0 END) + 20.0::DOUBLE * (CASE WHEN max(node) >= 5 THEN 1 ELSE 0 END) AS structured,
  0.30::DOUBLE * avg(prov) + 0.25::DOUBLE * avg(ent) + 0.25::DOUBLE * avg(coalesce(chk, 60)) + 0.20::DOUBLE * avg(fnd) AS verification FROM s GROUP BY 1)
SELECT document, round(coalesce(parse, 60), 4) AS parse, structured, round(verification, 4) AS verification, round(0.35::DOUBLE * coalesce(parse, 60) + 0.20::DOUBLE * structured + 0.45::DOUBLE * verification, 6) AS confidence FROM d
""")
def c_document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, structure and verification quality of each document, and its confidence."""
    neutral = F.coalesce("check", F.lit(NEUTRAL))
    structured = F.lit(40.0) + 20.0 * F.when(F.max("node") >= 3, 1).otherwise(0) + 20.0 * F.when(F.max("node") >= 5, 1).otherwise(0)
    verification = 0.30 * F.avg("provenance") + 0.25 * F.avg("entailment") + 0.25 * F.avg(neutral) + 0.20 * F.avg("findings")
    d = line_nodes(spark, sf_dir).groupBy("document").agg(F.coalesce(F.avg("parse"), F.lit(NEUTRAL)).alias("parse"), structured.alias("structured"), verification.alias("verification"))
    confidence = 0.35 * F.col("parse") + 0.20 * F.col("structured") + 0.45 * F.col("verification")
    return d.select("document", F.round("parse", 4).alias("parse"), "structured", F.round("verification", 4).alias("verification"), F.round(confidence, 6).alias("confidence"))


@query("""
WITH p AS (SELECT doc_id, quality, CASE WHEN s > 0.6 THEN 'true' WHEN s < 0.4 THEN 'false' ELSE 'uncertain' END AS said FROM (
  SELECT doc_id, quality, CASE WHEN contains(text, '!!') OR contains(text, '###') THEN 0.15::DOUBLE WHEN n_chars < 60 THEN 0.5::DOUBLE ELSE 0.92::DOUBLE END AS s FROM documents JOIN labels USING (doc_id)))
SELECT said, count(*) AS n, count(CASE WHEN (said = 'true') = (quality = 1) THEN 1 END) AS agreed, round(count(CASE WHEN (said = 'true') = (quality = 1) THEN 1 END)::DOUBLE / count(*), 4) AS accuracy FROM p GROUP BY 1
""")
def v25_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often scores, read as true above .6 and false below .4, agree with labels."""
    text = F.col("text")
    score = F.when(F.contains(text, F.lit("!!")) | F.contains(text, F.lit("###")), 0.15).when(F.col("n_chars") < 60, 0.5).otherwise(0.92)
    said = F.when(score > 0.6, "true").when(score < 0.4, "false").otherwise("uncertain")
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    agreed = F.count(F.when((F.col("said") == "true") == (F.col("quality") == 1), 1))
    return rows.groupBy("said").agg(F.count("*").alias("n"), agreed.alias("agreed"), F.round(agreed / F.count("*"), 4).alias("accuracy"))


def cost_usd(model: Column, fresh: Column, cached: Column, output: Column, prices: dict[str, tuple[float, float, float]]) -> Column:
    """Price of a run: fresh and cached input and output tokens by the million; null for unknown models."""
    found = F.lit(None).cast("double")
    for name, (i, c, o) in prices.items():
        found = F.when(model == name, (fresh * i + cached * c + output * o) / 1e6).otherwise(found)
    return found


PRICES = {"N": (3.0, 0.3, 15.0), "R": (0.25, 0.03, 1.25)}


@query("""
SELECT l_orderkey AS run, l_linenumber AS step, round(CASE l_returnflag WHEN 'N' THEN (l_quantity * 1000 * 3.0::DOUBLE + l_suppkey * 0.3::DOUBLE + l_extendedprice * 15.0::DOUBLE) / 1e6::DOUBLE
  WHEN 'R' THEN (l_quantity * 1000 * 0.25::DOUBLE + l_suppkey * 0.03::DOUBLE + l_extendedprice * 1.25::DOUBLE) / 1e6::DOUBLE END, 12) AS usd FROM lineitem
""")
def c_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usd = cost_usd(F.col("l_returnflag"), F.col("l_quantity") * 1000, F.col("l_suppkey"), F.col("l_extendedprice"), PRICES)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.round(usd, 12).alias("usd"))
