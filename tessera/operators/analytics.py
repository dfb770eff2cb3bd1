"""Aggregations behind the reports: health, categories, velocity, usage, budgets, counters."""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import AS_OF, audit_log, revisions, table


def daily_health(log: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Checks, passes, failures and the pass rate (percent, one digit) of each day, for some actions."""
    passed = F.sum(F.when(F.col("success") == 1, 1).otherwise(0))
    failed = F.sum(F.when(F.col("success") == 0, 1).otherwise(0))
    rate = F.round(passed.cast("double") * F.lit(100.0) / F.count("*"), 1)
    return (
        log.where(F.col("action").isin(*actions))
        .groupBy(F.to_date("created_at").alias("audit_date"))
        .agg(F.count("*").alias("total_checks"), passed.alias("passed_locks"), failed.alias("failed_locks"), rate.alias("pass_rate_pct"))
    )


@query("""
SELECT CAST(ts AS DATE) AS audit_date, count(*) AS total_checks,
       sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS passed_locks,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed_locks,
       round(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::DOUBLE * 100.0::DOUBLE / count(*), 1) AS pass_rate_pct
FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1
""")
def a1_daily_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_health(audit_log(spark, sf_dir), ("CLICK", "ERROR", "PURCHASE"))


def category_counts(log: DataFrame, marker: str, path: str) -> DataFrame:
    """How often each category (a JSON field, else the action) occurs in each project, for actions that contain ``marker``."""
    category = F.coalesce(F.get_json_object("details", path), F.col("action"))
    return log.where(F.col("action").contains(marker)).groupBy(category.alias("critique_category"), "project_id").agg(F.count("*").alias("frequency"))


@query("""
SELECT coalesce(json_extract_string(props, '$.k'), upper(event_type)) AS critique_category, user_id AS project_id, count(*) AS frequency
FROM events WHERE upper(event_type) LIKE '%IC%' OR upper(event_type) LIKE '%ERR%' GROUP BY ALL
""")
def a2_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_log(spark, sf_dir)
    return category_counts(log, "IC", "$.k").unionByName(category_counts(log, "ERR", "$.k")).groupBy("critique_category", "project_id").agg(F.sum("frequency").alias("frequency"))


def velocity(projects: DataFrame, sign_offs: DataFrame, locks: DataFrame) -> DataFrame:
    """Approved sign-offs of each project and whether it is locked, a row for each lock."""
    approved = sign_offs.where("status = 'approved'").groupBy("project_id").agg(F.count("*").alias("n"))
    return (
        projects.join(approved, "project_id", "left")
        .join(locks.select("project_id", "lock_id"), "project_id", "left")
        .select("project_id", "title", F.coalesce("n", F.lit(0)).cast("long").alias("total_sign_offs"), F.col("lock_id").isNotNull().cast("int").alias("is_locked"))
    )


@query("""
SELECT c_custkey AS project_id, c_name AS title,
       (SELECT count(*) FROM orders s WHERE s.o_custkey = c_custkey AND s.o_orderstatus = 'F') AS total_sign_offs,
       CASE WHEN l.o_orderkey IS NOT NULL THEN 1 ELSE 0 END AS is_locked
FROM customer LEFT JOIN orders l ON l.o_custkey = c_custkey AND l.o_orderstatus = 'P'
""")
def a3_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("title"))
    rows = revisions(spark, sf_dir)
    sign_offs = rows.select("project_id", F.when(F.col("status") == "F", "approved").otherwise("pending").alias("status"))
    locks = rows.where("status = 'P'").select("project_id", F.col("revision_id").alias("lock_id"))
    return velocity(projects, sign_offs, locks)


def usage_summary(runs: DataFrame, model: str, tokens: str, cost: Column, replied: Column) -> DataFrame:
    """Runs, replies, tokens, cost and reply rate by model and in total (model null).

    A missing or blank model is ``(unknown)``; a cost that no run reports stays null.
    """
    name = F.coalesce(F.nullif(F.trim(F.col(model)), F.lit("")), F.lit("(unknown)"))
    rows = runs.select(name.alias("model"), F.col(tokens).alias("tokens"), cost.alias("cost"), replied.cast("int").alias("replied"))
    sums = rows.rollup("model").agg(F.count("*").alias("runs"), F.sum("replied").alias("with_reply"), F.round(F.sum("tokens"), 2).alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"))
    return sums.withColumn("reply_rate", F.round(F.col("with_reply") / F.col("runs"), 4))


@query("""
SELECT l_shipmode_like AS model, count(*) AS runs, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS with_reply,
       round(sum(l_quantity), 2) AS tokens, round(sum(CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount END), 2) AS cost,
       round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS reply_rate
FROM (SELECT *, coalesce(nullif(trim(CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END), ''), '(unknown)') AS l_shipmode_like FROM lineitem)
GROUP BY ROLLUP (l_shipmode_like)
""")
def a4_usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").withColumn("target", F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")))
    cost = F.when(F.col("l_discount") > 0, F.col("l_extendedprice") * F.col("l_discount"))
    return usage_summary(runs, "target", "l_quantity", cost, F.col("l_linestatus") == "F")


def zero_filled_counts(rows: DataFrame, column: str, domain: Sequence[str], active: Sequence[str]) -> DataFrame:
    """Rows of each value of ``domain``, absent ones with 0, and the sums ``(active)`` and ``(total)``."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    values = spark.createDataFrame([(v,) for v in domain], "name string")
    filled = F.broadcast(values).join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    summed = counts.agg(
        F.coalesce(F.sum(F.when(F.col("name").isin(*active), F.col("n"))), F.lit(0)).cast("long").alias("active"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
    )
    return filled.unionByName(summed.select(F.explode(F.map_from_arrays(F.array(F.lit("(active)"), F.lit("(total)")), F.array("active", "total"))).alias("name", "n")))


STAGES = ("queued", "click", "view", "purchase", "signup", "error", "refund", "archived")


@query("""
WITH c AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1),
     d(name) AS (VALUES ('queued'), ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('refund'), ('archived'))
SELECT d.name, coalesce(c.n, 0) AS n FROM d LEFT JOIN c USING (name)
UNION ALL SELECT '(active)', coalesce(sum(CASE WHEN name IN ('queued', 'click', 'view') THEN n END), 0)::BIGINT FROM c
UNION ALL SELECT '(total)', coalesce(sum(n), 0)::BIGINT FROM c
""")
def a5_status_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_filled_counts(table(spark, sf_dir, "events"), "event_type", STAGES, STAGES[:3])


@query("""
SELECT name, sum(n)::BIGINT AS n, sum(distinct_keys)::BIGINT AS distinct_keys FROM (
  SELECT coalesce(nullif(trim(o_orderpriority), ''), 'unknown') AS name, count(*) AS n, count(DISTINCT o_custkey) AS distinct_keys FROM orders GROUP BY 1
  UNION ALL
  SELECT coalesce(nullif(trim(event_type), ''), 'unknown'), count(*), count(DISTINCT user_id) FROM events GROUP BY 1)
GROUP BY name
""")
def a6_model_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a label merged from two tables, blank labels as ``unknown``, with distinct keys of each."""

    def counted(rows: DataFrame, label: str, key: str) -> DataFrame:
        name = F.coalesce(F.nullif(F.trim(F.col(label)), F.lit("")), F.lit("unknown"))
        return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_keys"))

    both = counted(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey").unionByName(counted(table(spark, sf_dir, "events"), "event_type", "user_id"))
    return both.groupBy("name").agg(F.sum("n").alias("n"), F.sum("distinct_keys").alias("distinct_keys"))


def budget_remaining(ledger: DataFrame, limit: float) -> DataFrame:
    """Tokens that each project used and has left, not below zero."""
    return ledger.groupBy("project_id").agg(F.sum("tokens").alias("used")).withColumn("remaining", F.greatest(F.lit(0.0), F.lit(limit) - F.col("used")))


@query("""
SELECT o_custkey AS project_id, sum(l_quantity) AS used, greatest(0.0::DOUBLE, 250.0::DOUBLE - sum(l_quantity)) AS remaining
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def a7_budget_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("tokens"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"))
    return budget_remaining(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), 250.0)


@query("""
SELECT project_id, statuses, all_closed, CASE WHEN all_closed AND n > 0 THEN 'fetched' ELSE 'mixed' END AS origin FROM (
  SELECT o_custkey AS project_id, count(DISTINCT o_orderstatus) AS statuses, bool_and(o_orderstatus = 'F') AS all_closed, count(*) AS n FROM orders GROUP BY 1)
""")
def a10_origin_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group counts as fetched only if all of its rows are."""
    grouped = revisions(spark, sf_dir).groupBy("project_id").agg(F.count_distinct("status").alias("statuses"), F.bool_and(F.col("status") == "F").alias("all_closed"))
    return grouped.withColumn("origin", F.when(F.col("all_closed"), "fetched").otherwise("mixed"))


@query("""
SELECT source, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS supported,
       sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS partial,
       sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS carried,
       sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS unsupported,
       sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS unchecked
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def a11_verification_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of documents by source; partly supported ones count as carried too."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    good = F.col("quality") == 1
    return rows.groupBy("source").agg(
        count(good & (F.col("toxic") == 0)).alias("supported"),
        count(good & (F.col("toxic") == 1)).alias("partial"),
        count(good).alias("carried"),
        count(F.col("quality") == 0).alias("unsupported"),
        count(F.col("quality").isNull()).alias("unchecked"),
    )


@query("""
SELECT page, round(avg(score), 1) AS page_score, round(avg(score), 1) < 60 AS flagged
FROM (SELECT l_suppkey AS page, 100 * (1 - l_discount * 6) AS score FROM lineitem) GROUP BY page
""")
def a13_page_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each page's nodes; pages below 60 are flagged."""
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (100 * (1 - F.col("l_discount") * 6)).alias("score"))
    return nodes.groupBy("page").agg(F.round(F.avg("score"), 1).alias("page_score")).withColumn("flagged", F.col("page_score") < 60)


def confidence_buckets(spans: DataFrame, key: str, confidence: Column, size: Column) -> DataFrame:
    """Spans by confidence: high from .85, medium from .60, low from 0; null is in none. And all their characters."""
    between = lambda low, high: F.sum(F.when((confidence >= low) & (confidence < high), 1).otherwise(0))
    return spans.groupBy(key).agg(
        F.count("*").alias("spans"),
        F.sum(F.when(confidence >= 0.85, 1).otherwise(0)).alias("high"),
        between(0.60, 0.85).alias("medium"),
        between(0.0, 0.60).alias("low"),
        F.sum(size).alias("chars"),
    )


@query("""
SELECT source, count(*) AS spans, sum(CASE WHEN c >= 0.85 THEN 1 ELSE 0 END)::BIGINT AS high,
       sum(CASE WHEN c >= 0.60 AND c < 0.85 THEN 1 ELSE 0 END)::BIGINT AS medium,
       sum(CASE WHEN c >= 0 AND c < 0.60 THEN 1 ELSE 0 END)::BIGINT AS low, sum(n_chars)::BIGINT AS chars
FROM (SELECT source, n_chars, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 100) / 100.0::DOUBLE END AS c FROM documents) GROUP BY source
""")
def a14_confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 100) / F.lit(100.0))
    return confidence_buckets(table(spark, sf_dir, "documents"), "source", confidence, F.col("n_chars"))


@query("""
SELECT event_type AS suite, count(*) AS n, sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END)::BIGINT AS passed,
       round(avg(value / 100), 4) AS mean_accuracy, round(avg(CASE WHEN value >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS safety_rate
FROM events GROUP BY 1
""")
def a15_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, passes, mean accuracy and safety rate of each suite."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("suite")).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("value") >= 50, 1).otherwise(0)).alias("passed"),
        F.round(F.avg(F.col("value") / 100), 4).alias("mean_accuracy"),
        F.round(F.avg(F.when(F.col("value") >= 10, 1.0).otherwise(0.0)), 4).alias("safety_rate"),
    )


def running_mean(outcomes: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Mean of a key's outcomes in their order, rounded to four digits at each step, and their number.

    The rounding makes the mean depend on the order, so a key's outcomes are
    read one after the other by one task; they stream past in their order, and
    the task holds a mean and a number. A null outcome makes the mean null.
    """
    rows = outcomes.select(F.col(key).alias("key"), F.col(value).cast("double").alias("x"), *[F.col(o).alias(f"o{n}") for n, o in enumerate(order)])
    dealt = rows.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), *[f"o{n}" for n in range(len(order))], "x")
    kind = outcomes.schema[key].dataType.simpleString()
    return dealt.select("key", "x").mapInArrow(_running_means, f"key {kind}, score double, uses long").withColumnRenamed("key", key)


_PLACES = decimal.Decimal("0.0001")


def _rounded(x: float) -> float:
    """To four digits as decimals are rounded, half away from zero."""
    return float(decimal.Decimal(repr(x)).quantize(_PLACES, decimal.ROUND_HALF_UP)) if math.isfinite(x) else x


def _running_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of sorted rows (key, x)."""
    now, mean, n, kind = None, 0.0, 0, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.float64(), pa.int64()), strict=True)], names=["key", "score", "uses"])

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n and key != now:
                done.append((now, mean, n))
                mean, n = 0.0, 0
            now = key
            if mean is not None:
                mean = None if x is None else _rounded((mean * n + x) / (n + 1))
            n += 1
        yield rows(done)
    if n:
        yield rows([(now, mean, n)])


@query()
def a16_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_mean(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "value")


def feedback_delta(rating: Column, hallucinations: Column, tokens: Column) -> Column:
    """Change of a score by feedback: 0.15 by rating, 0.05 for no hallucination, 0.05 by few or many tokens."""
    by_rating = F.when(rating > 0, 0.15).when(rating < 0, -0.15).otherwise(0.0)
    by_tokens = F.when(tokens < 1500, 0.05).when(tokens > 3000, -0.05).otherwise(0.0)
    return by_rating + F.when(hallucinations == 0, 0.05).otherwise(0.0) + by_tokens


@query("""
SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100
  + (CASE WHEN event_type = 'purchase' THEN 0.15::DOUBLE WHEN event_type = 'error' THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN user_id % 3 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN value * 50 < 1500 THEN 0.05::DOUBLE WHEN value * 50 > 3000 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END))), 6) AS score
FROM events
""")
def a17_feedback_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    delta = feedback_delta(rating, F.col("user_id") % 3, F.col("value") * 50)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100 + delta))
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@query("""
SELECT n_name AS class, count(c_custkey) AS items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1
""")
def a18_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each class, 0 for classes without any."""
    items = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nations = table(spark, sf_dir, "nation")
    return nations.join(items, nations.n_nationkey == items.c_nationkey, "left").select(F.col("n_name").alias("class"), F.coalesce("n", F.lit(0)).cast("long").alias("items"))


@query("""
SELECT c_custkey AS project_id, coalesce(max(v), 0) + 1 AS next_version
FROM customer LEFT JOIN (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders) ON o_custkey = c_custkey
GROUP BY 1
""")
def a19_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each project's next revision gets."""
    latest = revisions(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("v"))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    return projects.join(latest, "project_id", "left").select("project_id", (F.coalesce("v", F.lit(0)) + 1).cast("long").alias("next_version"))


@query("""
SELECT project_id, nodes, findings, violations,
       CASE WHEN nodes = 0 THEN 'drafting' WHEN violations > 0 THEN 'verifying' WHEN findings > 0 THEN 'audited' ELSE 'ready_to_export' END AS status
FROM (SELECT c_custkey AS project_id, count(l_orderkey) AS nodes, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0)::BIGINT AS findings,
             coalesce(sum(CASE WHEN l_discount > 0.095 THEN 1 ELSE 0 END), 0)::BIGINT AS violations
      FROM customer
      LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey
      LEFT JOIN lineitem ON l_orderkey = o GROUP BY 1)
""")
def a21_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, findings and violations of each project's latest revision, and the status that follows."""
    newest = revisions(spark, sf_dir).groupBy("project_id").agg(F.max_by("revision_id", F.struct("created_at", "revision_id")).alias("revision_id"))
    nodes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("revision_id"), (F.col("l_returnflag") == "R").cast("int").alias("finding"), (F.col("l_discount") > 0.095).cast("int").alias("violation")
    )
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    counted = newest.join(nodes, "revision_id").groupBy("project_id").agg(F.count("*").alias("nodes"), F.sum("finding").alias("findings"), F.sum("violation").alias("violations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    filled = projects.join(counted, "project_id", "left").select("project_id", zero("nodes"), zero("findings"), zero("violations"))
    status = F.when(F.col("nodes") == 0, "drafting").when(F.col("violations") > 0, "verifying").when(F.col("findings") > 0, "audited").otherwise("ready_to_export")
    return filled.withColumn("status", status)


@query(f"""
SELECT event_type AS action, max(ts) AS last_success,
       round(epoch(TIMESTAMP '{AS_OF}' - max(ts)) / 3600, 4) AS hours_since,
       CASE WHEN max(ts) IS NULL THEN 'never_run' WHEN epoch(TIMESTAMP '{AS_OF}' - max(ts)) / 3600 <= 48 THEN 'ok' ELSE 'stale' END AS state
FROM events WHERE value > 95 GROUP BY 1
""")
def a23_backup_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since each action last succeeded, and whether that is recent enough."""
    last = table(spark, sf_dir, "events").where("value > 95").groupBy(F.col("event_type").alias("action")).agg(F.max("ts").alias("last_success"))
    hours = (F.unix_micros(F.to_timestamp(F.lit(AS_OF))) - F.unix_micros(F.col("last_success").cast("timestamp"))) / F.lit(3.6e9)
    state = F.when(F.col("last_success").isNull(), "never_run").when(hours <= 48, "ok").otherwise("stale")
    return last.select("action", "last_success", F.round(hours, 4).alias("hours_since"), state.alias("state"))


@query("""
SELECT o_custkey AS wallet, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END), 2) AS balance,
       round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END), 2) >= 100000 AS allowed
FROM orders GROUP BY 1
""")
def a24_wallet_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of each wallet as the sum of its transactions, and whether it covers a cost of 100000."""
    signed = F.when(F.col("status") == "O", F.col("size")).otherwise(-F.col("size"))
    return revisions(spark, sf_dir).groupBy(F.col("project_id").alias("wallet")).agg(F.round(F.sum(signed), 2).alias("balance")).withColumn("allowed", F.col("balance") >= 100000)
