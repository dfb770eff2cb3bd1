"""Writes as table algebra: replacing, ignoring, counting, expiring, versioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table


def upsert_latest(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``stored`` with ``new`` merged in: of a key's rows the last by ``order`` stays, new ones before equal stored ones."""
    both = stored.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    others = [c for c in stored.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order, "is_new"))
    return both.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")


@query("""
WITH b AS (SELECT user_id, event_type, value, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS fresh FROM events)
SELECT user_id, event_type, value, ts, event_id FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, fresh DESC) = 1
""")
def k2_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return upsert_latest(rows.where("event_id % 2 <> 0"), rows.where("event_id % 2 = 0"), ("user_id", "event_type"), ("ts", "event_id"))


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` whose keys it lacks."""
    return stored.unionByName(new.join(stored.select(*keys).distinct(), list(keys), "left_anti").select(*stored.columns))


@query("""
SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer c WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0
""")
def k3_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return insert_ignore(rows.where("id % 3 = 0"), rows.where("id % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")), ("id",))


def daily_counter(events: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """Uses of each key and UTC day, and whether they passed the day's limit."""
    counts = events.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("uses"))
    return counts.withColumn("over_limit", F.col("uses") > limit)


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS uses, count(*) > 5 AS over_limit FROM events GROUP BY 1, 2")
def k4_daily_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_counter(table(spark, sf_dir, "events"), "user_id", "ts", 5)


def purge(rows: DataFrame, gone: Column) -> DataFrame:
    """What a delete leaves: rows for which the condition is false or unknown."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


@query("SELECT event_id, ts FROM events WHERE NOT coalesce(ts < TIMESTAMP '2024-01-15 00:00:00' AND event_type = 'view', false)")
def k5_purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = (F.col("ts") < F.to_timestamp(F.lit("2024-01-15 00:00:00"))) & (F.col("event_type") == "view")
    return purge(table(spark, sf_dir, "events"), old).select("event_id", "ts")


def replace_sets(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with all rows of the keys that ``new`` has replaced by its rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(new)


@query("""
SELECT l_orderkey AS project_id, l_linenumber AS line, l_quantity AS amount FROM lineitem WHERE l_orderkey % 4 <> 0
UNION ALL SELECT DISTINCT l_orderkey, 0, 1.0::DOUBLE FROM lineitem WHERE l_orderkey % 4 = 0
""")
def k6_replace_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("amount"))
    new = rows.where("project_id % 4 = 0").select("project_id", F.lit(0).alias("line"), F.lit(1.0).alias("amount")).distinct()
    return replace_sets(rows, new, "project_id")


def save_versions(stored: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """New rows with their versions, or a conflict where they expected another one than the stored maximum.

    Several new rows of a key are taken in order; each is held against the version before it.
    """
    current = stored.groupBy(key).agg(F.max("version").alias("current"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    held = new.join(current, key, "left").withColumn("version", F.coalesce("current", F.lit(0)) + place)
    return held.withColumn("saved", F.col("expected").isNull() | (F.col("expected") == F.col("version") - 1))


@query("""
WITH r AS (SELECT o_custkey AS project_id, o_orderkey AS revision, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders),
     s AS (SELECT project_id, max(version) AS cur FROM r WHERE version <= 3 GROUP BY 1),
     n AS (SELECT project_id, revision, CASE WHEN revision % 3 = 0 THEN NULL ELSE 3 END AS expected, row_number() OVER (PARTITION BY project_id ORDER BY revision) AS place FROM r WHERE version > 3)
SELECT project_id, revision, expected, coalesce(cur, 0) + place AS version, expected IS NULL OR expected = coalesce(cur, 0) + place - 1 AS saved FROM n LEFT JOIN s USING (project_id)
""")
def k7_versioned_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = Window.partitionBy("project_id").orderBy("o_orderdate", "revision")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("revision"), "o_orderdate").withColumn("version", F.row_number().over(in_order))
    new = rows.where("version > 3").select("project_id", "revision", F.when(F.col("revision") % 3 != 0, 3).alias("expected"))
    return save_versions(rows.where("version <= 3"), new, "project_id", ("revision",)).select("project_id", "revision", "expected", "version", "saved")
