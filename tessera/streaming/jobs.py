"""Incremental operators on streams, each with the batch query that gives the same rows.

A source is a streaming DataFrame with the columns of ``events``. Queries run
a stream over the events file until all of it is read, into a table in the
shared folder, and return that table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    # Watermarks want timestamps of a time zone; the session's is UTC.
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs ``stream`` over all that is there and returns what it wrote.

    In update and complete mode each batch replaces the table's rows of its
    number, and the caller takes what it needs of the batches by ``batch``.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(each or write).start()
    run.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{folder}/out")


def first_seen(stream: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """A writer of a stream's batches that keeps only rows which no earlier batch had.

    What was seen is the table itself, so nothing is forgotten and no state
    grows in memory; a batch that is delivered again sees the batches before
    it only, and replaces what it wrote.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.distinct()
        if number:
            before = batch.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("n", T.IntegerType())])).parquet(f"{folder}/out").where(F.col("n") < number)
            same = [fresh[c].eqNullSafe(before[c]) for c in schema.names]
            fresh = fresh.join(before, reduce(lambda a, b: a & b, same), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    return write


@query("SELECT lower(event_type) || '-' || user_id AS claim FROM events GROUP BY 1")
def r1_distinct_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims verified once each while they stream in, whatever the case of their letters and however late they come again."""
    folder = shared_folder(spark)
    claims = event_stream(spark, sf_dir).select(F.concat_ws("-", F.lower("event_type"), "user_id").alias("claim"))
    run = claims.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(first_seen(claims, folder)).start()
    run.awaitTermination()
    return spark.read.schema(claims.schema).parquet(f"{folder}/out").select("claim")


def quiet_periods(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Runs of a key's events without a pause of ``gap``: one job each, after the pause."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("edits")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("fires_at"), "edits")


_SESSIONS = """
WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS fires_at, count(*) AS edits FROM s GROUP BY user_id, sid
"""


@query(_SESSIONS)
def r2_debounce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiet_periods(table(spark, sf_dir, "events"), "user_id", "6 hours")


@query(f"SELECT * FROM ({_SESSIONS}) WHERE fires_at < (SELECT max(ts) FROM events)")
def r2_debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet periods that have ended by the stream's watermark; later ones stay open."""
    events = event_stream(spark, sf_dir).withWatermark("ts", "0 seconds")
    found = drained(quiet_periods(events, "user_id", "6 hours"))
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("user_id", plain("start"), plain("fires_at"), "edits")


@query("""
SELECT user_id, event_id, value FROM events WHERE value >= 0 QUALIFY floor(value / 10) = max(floor(value / 10)) OVER (PARTITION BY user_id)
""")
def r3_generation_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only results of each key's newest generation: a task of an older one is stale."""
    rows = table(spark, sf_dir, "events").withColumn("generation", F.floor(F.col("value") / 10))
    newest = rows.groupBy("user_id").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["user_id", "generation"]).select("user_id", "event_id", "value")


def job_history(events: DataFrame) -> DataFrame:
    """Each job's stages in order, its last one, and the time from start to end.

    Status and duration are partial aggregates. Stages are put in order within
    days first and days within the job, so no task sorts all of a job's
    events; the history itself is as long as the job.
    """
    order = F.struct("ts", "event_id")
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"]), ">").alias("part"),
        F.max_by("event_type", order).alias("status"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    jobs = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "part"))).alias("days"), F.max_by("status", "day").alias("status"), F.min("first").alias("first"), F.max("last").alias("last"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return jobs.select("user_id", F.array_join(F.transform("days", lambda d: d["part"]), ">").alias("history"), "status", (micros("last") - micros("first")).alias("duration_us"))


@query("""
SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS history, arg_max(event_type, (ts, event_id)) AS status, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS duration_us FROM events GROUP BY 1
""")
def r4_job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_history(table(spark, sf_dir, "events"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS uses, count(*) > 5 AS over_limit FROM events GROUP BY 1, 2")
def r5_daily_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each key and day as they stream in; of a key's updates the last batch's counts."""
    day = F.window("ts", "1 day").alias("w")
    counts = event_stream(spark, sf_dir).groupBy("user_id", day).agg(F.count("*").alias("uses"))
    updates = drained(counts.select("user_id", F.to_date("w.start").alias("day"), "uses"), "update")
    last = updates.groupBy("user_id", "day").agg(F.max_by("uses", "batch").alias("uses"))
    return last.withColumn("over_limit", F.col("uses") > 5)


@query("""
SELECT user_id, event_type, count(*) AS findings, round(max(value), 6) AS worst FROM events GROUP BY 1, 2
""")
def r9_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings merged into one row of telemetry for each project and kind as they arrive."""
    grouped = event_stream(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("findings"), F.max("value").alias("worst"))
    updates = drained(grouped, "update")
    last = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("batch")))
    return updates.withColumn("place", last).where("place = 1").select("user_id", "event_type", "findings", F.round("worst", 6).alias("worst"))
