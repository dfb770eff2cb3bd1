"""Numbers against locked facts: satisfaction is comparison, since every formula has one variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import slug
from tessera.registry import query
from tessera.sources.tables import table

RELATIONS = ("eq", "lt", "le", "gt", "ge")


def close(a: Column, b: Column) -> Column:
    """Equal within a relative 1e-9."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def holds(relation: Column, a: Column, b: Column) -> Column:
    same = close(a, b)
    return F.when(relation == "eq", same).when(relation == "lt", (a < b) & ~same).when(relation == "le", (a < b) | same).when(relation == "gt", (a > b) & ~same).when(relation == "ge", (a > b) | same)


def facts_of(locks: DataFrame) -> DataFrame:
    """name and value of the names that all locks agree on; name, null and the keys for ambiguous ones.

    locks: canonical_key, metric, value; a lock answers to both names, normalised.
    """
    names = locks.where("value IS NOT NULL").select("canonical_key", "value", F.explode(F.array(slug(F.col("canonical_key")), slug(F.col("metric")))).alias("name")).where("name <> ''")
    grouped = names.groupBy("name").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"), F.array_sort(F.collect_set("canonical_key")).alias("keys"))
    return grouped.select("name", F.when(F.col("values") == 1, F.col("value")).alias("value"), (F.col("values") > 1).alias("ambiguous"), F.size("keys").cast("long").alias("keys"))


_LOCKS = "locks AS (SELECT 'part ' || p_partkey AS canonical_key, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type || p_partkey END AS metric, CASE WHEN p_partkey % 17 <> 0 THEN p_size::DOUBLE END AS value FROM part)"
_NAME = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"


def part_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_type", "p_partkey"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part "), "p_partkey").alias("canonical_key"), metric.alias("metric"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_size").cast("double")).alias("value"))


@query(f"""
WITH {_LOCKS}, n AS (SELECT canonical_key, value, {_NAME.format("canonical_key")} AS name FROM locks WHERE value IS NOT NULL UNION ALL SELECT canonical_key, value, {_NAME.format("metric")} FROM locks WHERE value IS NOT NULL)
SELECT name, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS ambiguous, count(DISTINCT canonical_key) AS keys FROM n WHERE name <> '' GROUP BY 1
""")
def v11_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(part_locks(spark, sf_dir))


def check_relations(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """UNKNOWN, VIOLATED or VERIFIED for each claim: claim_id, operand, metric, relation, claimed, expected.

    Unknown without a known relation, numbers or an unambiguous fact, or when
    the claim's own numbers break its relation; violated when the claimed
    value isn't the fact's, or the fact breaks the relation.
    """
    known = facts.where("value IS NOT NULL").select("name", "value")
    op = known.select(F.col("name").alias("operand_name"), F.col("value").alias("operand_fact"))
    me = known.select(F.col("name").alias("metric_name"), F.col("value").alias("metric_fact"))
    found = claims.withColumn("operand_name", slug(F.col("operand"))).withColumn("metric_name", slug(F.col("metric"))).join(op, "operand_name", "left").join(me, "metric_name", "left")
    fact = F.coalesce("operand_fact", "metric_fact")
    numbers = F.col("claimed").isNotNull() & F.col("expected").isNotNull()
    usable = F.col("relation").isin(*RELATIONS) & numbers & fact.isNotNull() & holds(F.col("relation"), F.col("claimed"), F.col("expected"))
    right = close(F.col("claimed"), fact) & holds(F.col("relation"), fact, F.col("expected"))
    verdict = F.when(~F.coalesce(usable, F.lit(False)), "UNKNOWN").when(right, "VERIFIED").otherwise("VIOLATED")
    return found.select("claim_id", "relation", "claimed", "expected", fact.alias("fact"), verdict.alias("verdict"))


@query(f"""
WITH {_LOCKS}, n AS (SELECT value, {_NAME.format("canonical_key")} AS name FROM locks WHERE value IS NOT NULL UNION ALL SELECT value, {_NAME.format("metric")} FROM locks WHERE value IS NOT NULL),
f AS (SELECT name, min(value) AS value FROM n WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT value) = 1),
c AS (SELECT p_partkey AS claim_id, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE 'Part ' || p_partkey END AS operand, p_brand AS metric, ['eq', 'lt', 'le', 'gt', 'ge', 'like'][(p_partkey % 6 + 1)::INT] AS relation,
  (p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE AS claimed, CASE WHEN p_partkey % 13 <> 0 THEN 25.0::DOUBLE END AS expected FROM part),
j AS (SELECT c.*, coalesce(a.value, b.value) AS fact FROM c LEFT JOIN f a ON a.name = {_NAME.format("operand")} LEFT JOIN f b ON b.name = {_NAME.format("metric")}),
h AS (SELECT *, CASE relation WHEN 'eq' THEN claimed = expected WHEN 'lt' THEN claimed < expected WHEN 'le' THEN claimed <= expected WHEN 'gt' THEN claimed > expected WHEN 'ge' THEN claimed >= expected END AS own,
  CASE relation WHEN 'eq' THEN fact = expected WHEN 'lt' THEN fact < expected WHEN 'le' THEN fact <= expected WHEN 'gt' THEN fact > expected WHEN 'ge' THEN fact >= expected END AS src FROM j)
SELECT claim_id, relation, claimed, expected, fact, CASE WHEN NOT coalesce(own, false) OR fact IS NULL THEN 'UNKNOWN' WHEN claimed = fact AND src THEN 'VERIFIED' ELSE 'VIOLATED' END AS verdict FROM h
""")
def v27_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    claims = table(spark, sf_dir, "part").select(
        key.alias("claim_id"),
        F.when(key % 4 == 0, "x").otherwise(F.concat(F.lit("Part "), key)).alias("operand"),
        F.col("p_brand").alias("metric"),
        F.element_at(F.array(*[F.lit(r) for r in (*RELATIONS, "like")]), (key % 6 + 1).cast("int")).alias("relation"),
        (F.col("p_size") + F.when(key % 5 == 0, 1).otherwise(0)).cast("double").alias("claimed"),
        F.when(key % 13 != 0, 25.0).alias("expected"),
    )
    return check_relations(claims, facts_of(part_locks(spark, sf_dir)))


def check_claims(claims: DataFrame, locks: DataFrame, key: str) -> DataFrame:
    """Score of each claim against its ledger: 0.92 if a number equals a lock, 0.15 if one only differs, 0.5 without either.

    claims: claim_id, key and numbers (an array); locks: key and value.
    """
    values = locks.where("value IS NOT NULL").select(key, F.col("value").alias("lock")).distinct()
    each = claims.select("claim_id", key, F.explode("numbers").alias("number")).join(values, key)
    met = each.groupBy("claim_id").agg(F.bool_or(F.abs(F.col("number") - F.col("lock")) < 1e-9).alias("matched"))
    status = F.when(F.col("matched"), "true").when(~F.col("matched"), "false").otherwise("uncertain")
    score = F.when(F.col("matched"), 0.92).when(~F.col("matched"), 0.15).otherwise(0.5)
    return claims.select("claim_id").join(met, "claim_id", "left").select("claim_id", status.alias("status"), score.alias("score"))


@query("""
WITH c AS (SELECT o_orderkey AS claim_id, o_custkey % 25 AS k, CASE WHEN o_orderkey % 7 = 0 THEN [] ELSE [(o_orderkey % 50)::DOUBLE, (o_orderkey % 30)::DOUBLE] END AS ns FROM orders),
l AS (SELECT DISTINCT n_nationkey AS k, unnest([n_regionkey * 10.0::DOUBLE, n_nationkey::DOUBLE]) AS lock FROM nation WHERE n_nationkey % 6 <> 0),
m AS (SELECT claim_id, bool_or(number = lock) AS matched FROM (SELECT claim_id, k, unnest(ns) AS number FROM c) JOIN l USING (k) GROUP BY 1)
SELECT claim_id, CASE WHEN matched THEN 'true' WHEN NOT matched THEN 'false' ELSE 'uncertain' END AS status, CASE WHEN matched THEN 0.92::DOUBLE WHEN NOT matched THEN 0.15::DOUBLE ELSE 0.5::DOUBLE END AS score FROM c LEFT JOIN m USING (claim_id)
""")
def v11_claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.when(F.col("o_orderkey") % 7 != 0, F.array((F.col("o_orderkey") % 50).cast("double"), (F.col("o_orderkey") % 30).cast("double"))).otherwise(F.array().cast("array<double>"))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") % 25).alias("k"), numbers.alias("numbers"))
    locks = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").cast("long").alias("k"), F.explode(F.array(F.col("n_regionkey") * F.lit(10.0), F.col("n_nationkey").cast("double"))).alias("value"))
    return check_claims(claims, locks, "k")


@query("""
WITH s AS (SELECT o_custkey AS project_id, CASE WHEN o_orderstatus = 'P' THEN 'bad' WHEN o_totalprice > 150000 THEN 'checked' END AS state FROM orders),
c AS (SELECT c_custkey AS project_id, count(state) AS locks, count(CASE WHEN state = 'bad' THEN 1 END) AS bad, count(CASE WHEN state = 'checked' THEN 1 END) AS checked FROM customer LEFT JOIN s ON s.project_id = c_custkey GROUP BY 1)
SELECT project_id, bad, checked, CASE WHEN bad > 0 THEN 'VIOLATION' WHEN checked > 0 THEN 'PASS' ELSE 'SKIPPED' END AS status FROM c
""")
def v27_lock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's check: violated by any bad lock, passed by any checked one, skipped without either."""
    state = F.when(F.col("o_orderstatus") == "P", "bad").when(F.col("o_totalprice") > 150000, "checked")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count(F.when(state == "bad", 1)).alias("bad"), F.count(F.when(state == "checked", 1)).alias("checked"))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id")).join(counts, "project_id", "left").fillna(0)
    return projects.withColumn("status", F.when(F.col("bad") > 0, "VIOLATION").when(F.col("checked") > 0, "PASS").otherwise("SKIPPED"))


@query("""
WITH c AS (SELECT p_partkey, lower(p_brand) || '_' || lower(p_type) AS m, p_size::DOUBLE AS value, (p_partkey % 100) / 100.0::DOUBLE AS confidence FROM part)
SELECT p_partkey, trim(regexp_replace(m, '[^a-z0-9]+', '_', 'g'), '_') AS canonical_key, value FROM c WHERE confidence >= 0.7
UNION ALL SELECT p_partkey, 'entity_' || p_partkey, 1.0::DOUBLE FROM c
""")
def v26_lock_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock candidates from JSON answers: sure enough, with a number and a name, under one key."""
    one = F.struct(F.col("p_brand").alias("entity"), F.col("p_type").alias("metric"), F.col("p_size").cast("string").alias("value"), ((F.col("p_partkey") % 100) / 100).alias("confidence"))
    two = F.struct(F.lit("entity").alias("entity"), F.col("p_partkey").cast("string").alias("metric"), F.lit("1").alias("value"), F.lit(0.9).alias("confidence"))
    bad = F.struct(F.lit("x").alias("entity"), F.lit("y").alias("metric"), F.lit("n/a").alias("value"), F.lit(0.9).alias("confidence"))
    answers = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.array(one, two, bad).alias("candidates"))).alias("answer"))
    schema = "candidates array<struct<entity:string,metric:string,value:string,confidence:double>>"
    each = answers.select("p_partkey", F.explode(F.from_json("answer", schema)["candidates"]).alias("c"))
    value = F.expr("try_cast(c.value AS double)")
    named = F.coalesce("c.entity", "c.metric").isNotNull()
    return each.where((F.col("c.confidence") >= 0.7) & value.isNotNull() & named).select("p_partkey", slug(F.concat_ws("_", "c.entity", "c.metric")).alias("canonical_key"), value.alias("value"))
