"""Filters and projections of the operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import AS_OF, audit_log, revisions, table


def search_history(works: DataFrame, as_of: Column, days: int | None, text: str | None, columns: tuple[str, ...], order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of the works of the last ``days`` that contain ``text`` in any of ``columns``, letters' case apart.

    limit is held between 1 and 100 and offset at 0 or more.
    """
    if days is not None:
        works = works.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    if text:
        found = F.lit(False)
        for column in columns:
            found = found | F.coalesce(F.col(column), F.lit("")).contains(text)
        works = works.where(found)
    return works.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


@query("""
SELECT c_custkey AS project_id, o_orderkey AS revision_id, o_orderpriority AS priority, c_name AS title FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 400 DAYS AND (o_orderpriority LIKE '%URG%' OR c_name LIKE '%URG%')
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 5
""")
def p1_history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("title"))
    works = revisions(spark, sf_dir).join(titles, "project_id")
    page = search_history(works, F.to_timestamp(F.lit("1998-08-01")), 400, "URG", ("priority", "title"), [F.desc("created_at"), F.asc("revision_id")], 50, 5)
    return page.select("project_id", "revision_id", "priority", "title")


def owned_by(rows: DataFrame, owner: str, user: str | None) -> DataFrame:
    """Rows whose owner is the user, where a missing user owns the rows without one."""
    return rows.where(F.col(owner).eqNullSafe(F.lit(user)))


@query("""
SELECT 'none' AS asked, count(*) AS n FROM (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS owner FROM events) WHERE owner IS NOT DISTINCT FROM NULL
UNION ALL SELECT '7', count(*) FROM (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS owner FROM events) WHERE owner IS NOT DISTINCT FROM 7
""")
def p2_null_safe_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("owner"))
    count = lambda name, user: owned_by(rows, "owner", user).agg(F.lit(name).alias("asked"), F.count("*").alias("n"))
    return count("none", None).unionByName(count("7", 7))


def visible_to(owner: Column, user: Column) -> Column:
    """Whether a row with that owner is the user's or nobody's."""
    return (owner == user) | owner.isNull() | (owner == "")


@query("""
SELECT event_id, owner FROM (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN '' ELSE user_id::VARCHAR END AS owner FROM events)
WHERE owner = '22' OR owner IS NULL OR owner = ''
""")
def p3_owner_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("user_id") % 10 == 1, "").when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", owner.alias("owner")).where(visible_to(F.col("owner"), F.lit("22")))


def in_workspace(workspace: Column, asked: str) -> Column:
    """Rows of a workspace; those without one belong to ``default``."""
    return (workspace == asked) | (workspace.isNull() & F.lit(asked == "default"))


@query("""
SELECT event_id, ws FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'default' ELSE 'w' || user_id END AS ws FROM events)
WHERE ws = 'default' OR ws IS NULL
""")
def p4_workspace_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.when(F.col("user_id") % 4 == 1, "default").when(F.col("user_id") % 4 != 0, F.concat(F.lit("w"), F.col("user_id")))
    return table(spark, sf_dir, "events").select("event_id", ws.alias("ws")).where(in_workspace(F.col("ws"), "default"))


def live(rows: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows that never expire or do so after ``as_of``."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > as_of))


@query(f"""
SELECT event_id, expires_at FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 10 DAYS END AS expires_at FROM events)
WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}'
""")
def p5_live_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    expires = F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    return live(table(spark, sf_dir, "events").select("event_id", expires.alias("expires_at")), "expires_at", F.to_timestamp(F.lit(AS_OF)))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type IN ('click', 'view', 'signup')")
def p6_active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in one of the active states."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "signup")).select("event_id", "user_id", "ts")


@query("""
SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_retailprice END AS score FROM part)
ORDER BY score DESC NULLS LAST, p_partkey LIMIT 300
""")
def p7_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 300 by score, those without a score last."""
    scored = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), "p_partkey").limit(300)


def recency(ts: Column, as_of: Column) -> Column:
    """today, yesterday, week (the seven days before) or older; a missing time is older."""
    age = F.datediff(F.to_date(as_of), F.to_date(ts))
    return F.when(age <= 0, "today").when(age == 1, "yesterday").when(age <= 7, "week").otherwise("older")


@query("""
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN a <= 0 THEN 'today' WHEN a = 1 THEN 'yesterday' WHEN a <= 7 THEN 'week' ELSE 'older' END AS bucket
  FROM (SELECT date_diff('day', CAST(CASE WHEN event_type <> 'error' THEN ts END AS DATE), DATE '2024-01-30') AS a FROM events)) GROUP BY 1
""")
def p9_recency_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, sf_dir, "events").groupBy(recency(ts, F.to_date(F.lit("2024-01-30"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, left(props, 80) AS preview, CASE WHEN event_type = 'purchase' THEN 'ground' WHEN value > 50 THEN 'ready' ELSE 'copy' END AS badge FROM events
""")
def p10_public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as shown to the public, with a badge: grounded, with a reply, or a copy."""
    badge = F.when(F.col("event_type") == "purchase", "ground").when(F.col("value") > 50, "ready").otherwise("copy")
    return table(spark, sf_dir, "events").select("event_id", F.substring("props", 1, 80).alias("preview"), badge.alias("badge"))


@query("""
SELECT coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 3 = 1 THEN NULL ELSE source END), ''), 'unknown') AS label, count(*) AS n FROM documents GROUP BY 1
""")
def p11_label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 2, F.col("source"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


def activity(log: DataFrame, project: int | None = None, action: str | None = None, limit: int = 2000) -> DataFrame:
    """The newest activity that fits the filters given, 1 to 2000 rows, with details that are not JSON as null."""
    if project is not None:
        log = log.where(F.col("project_id") == project)
    if action is not None:
        log = log.where(F.col("action") == action)
    newest = log.orderBy(F.desc("created_at"), "id").limit(max(1, min(limit, 2000)))
    return newest.select("id", "project_id", "action", F.get_json_object("details", "$.k").cast("long").alias("k"), "created_at")


@query("""
SELECT event_id AS id, user_id AS project_id, upper(event_type) AS action, json_extract_string(props, '$.k')::BIGINT AS k, ts AS created_at
FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 2000
""")
def p12_activity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(audit_log(spark, sf_dir), action="CLICK", limit=5000)
