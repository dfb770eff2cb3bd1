"""Joins: latest and fallback rows, differences, facts, anchors and hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import revisions, table


@query("""
SELECT c_custkey AS project_id, c_mktsegment AS segment, o_orderkey AS lock_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
""")
def j1_left_lock_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project, once for each of its locks or once without one."""
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("segment"))
    locks = revisions(spark, sf_dir).where("status = 'P'").select("project_id", F.col("revision_id").alias("lock_id"))
    return projects.join(locks, "project_id", "left")


@query("""
SELECT o_orderkey AS run, l_linenumber AS version, l_shipdate AS at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1
WHERE o_orderpriority LIKE '%HIGH%' OR l_returnflag LIKE '%R%'
""")
def j2_history_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose own text or whose first version's contains a string."""
    runs = table(spark, sf_dir, "orders")
    versions = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    both = runs.join(versions, runs.o_orderkey == versions.l_orderkey, "left")
    return both.where(F.col("o_orderpriority").contains("HIGH") | F.col("l_returnflag").contains("R")).select(
        F.col("o_orderkey").alias("run"), F.col("l_linenumber").alias("version"), F.col("l_shipdate").alias("at")
    )


@query("""
SELECT l_orderkey AS run, l_linenumber AS finding, o_orderpriority AS workspace FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_returnflag = 'R' AND (o_orderpriority = '1-URGENT' OR o_orderstatus = 'P')
""")
def j3_findings_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings with their runs, of a workspace or of none."""
    findings = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    runs = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'")
    return findings.join(runs, findings.l_orderkey == runs.o_orderkey).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("finding"), F.col("o_orderpriority").alias("workspace"))


@query("""
SELECT c_custkey AS project_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS revisions,
       (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS approved FROM customer
""")
def j4_scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts of each project, from one aggregation."""
    counts = revisions(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("revisions"), F.count(F.when(F.col("status") == "F", 1)).alias("approved"))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return projects.join(counts, "project_id", "left").select("project_id", zero("revisions"), zero("approved"))


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, whose end must be unique; one aggregation, no sort of groups."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last")).select(key, "last.*")


@query("""
SELECT o_custkey AS project_id, o_orderkey AS revision_id, o_orderstatus AS status, o_totalprice AS size, o_orderpriority AS priority, o_orderdate AS created_at
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def j5_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(revisions(spark, sf_dir), "project_id", ("created_at", "revision_id"))


def node_diff(previous: DataFrame, current: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Nodes added, removed or changed between two versions, by a digest of their payload."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in payload]), 256)
    before = previous.select(key, digest.alias("before"))
    after = current.select(key, digest.alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return before.join(after, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


@query("""
WITH p AS (SELECT p_partkey AS node_id, p_name || '|' || p_size AS h FROM part WHERE p_partkey % 10 <> 0),
     c AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey % 7 = 0 THEN 'new ' || p_name ELSE p_name END || '|' || p_size AS h FROM part WHERE p_partkey % 10 <> 1)
SELECT coalesce(p.node_id, c.node_id) AS node_id, CASE WHEN p.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM p FULL JOIN c ON p.node_id = c.node_id WHERE p.h IS DISTINCT FROM c.h
""")
def j10_node_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_name", "p_size")
    changed = nodes.where("node_id % 10 <> 1").withColumn("p_name", F.when(F.col("node_id") % 7 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name")))
    return node_diff(nodes.where("node_id % 10 <> 0"), changed, "node_id", ("p_name", "p_size"))


@query(r"""
WITH c AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+ed\b')) AS cited FROM conversations),
     m AS (SELECT lower(word) AS word, min(item_id) AS sentence FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark) GROUP BY 1)
SELECT conv_id, turn, cited, sentence FROM (SELECT DISTINCT conv_id, turn, cited FROM c) JOIN m ON lower(cited) = word
""")
def j11_citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that a text carries, mapped to the sentence each stands for; unmapped ones go."""
    marks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+ed\b"), F.lit(0)))).alias("cited"))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    mapped = words.groupBy(F.lower("word").alias("word")).agg(F.min("item_id").alias("sentence"))
    return marks.join(mapped, F.lower("cited") == F.col("word")).select("conv_id", "turn", "cited", "sentence")


def look_up_facts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Each claim's fact by its operand's name, else by its metric's; the value is null if neither is known.

    claims: claim_id, operand, metric, claimed; facts: name, value.
    """
    by_operand = facts.select(F.col("name").alias("operand"), F.col("value").alias("operand_value"))
    by_metric = facts.select(F.col("name").alias("metric"), F.col("value").alias("metric_value"))
    found = claims.join(by_operand, "operand", "left").join(by_metric, "metric", "left")
    return found.select("claim_id", "operand", "metric", "claimed", F.coalesce("operand_value", "metric_value").alias("fact"))


@query("""
WITH f AS (SELECT p_type AS name, max(p_retailprice) AS value FROM part GROUP BY 1 UNION ALL SELECT p_brand, max(p_retailprice) FROM part GROUP BY 1),
     c AS (SELECT p_partkey AS claim_id, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_type END AS operand, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE p_brand END AS metric, p_retailprice AS claimed FROM part)
SELECT claim_id, operand, metric, claimed, coalesce(a.value, b.value) AS fact FROM c LEFT JOIN f a ON a.name = operand LEFT JOIN f b ON b.name = metric
""")
def j12_fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    named = lambda c: part.groupBy(F.col(c).alias("name")).agg(F.max("p_retailprice").alias("value"))
    name = lambda c, n: F.when(F.col("p_partkey") % n == 0, "none").otherwise(F.col(c))
    claims = part.select(F.col("p_partkey").alias("claim_id"), name("p_type", 3).alias("operand"), name("p_brand", 5).alias("metric"), F.col("p_retailprice").alias("claimed"))
    return look_up_facts(claims, named("p_type").unionByName(named("p_brand")))


def unresolved(anchors: DataFrame, manifest: DataFrame) -> DataFrame:
    """Anchors whose source is in the manifest neither by id nor by name: two equi-joins instead of one with OR."""
    by_id = anchors.join(manifest.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti")
    return by_id.join(manifest.select(F.col("name").alias("source_name")).distinct(), "source_name", "left_anti").select(*anchors.columns)


@query("""
SELECT l_orderkey AS anchor, l_linenumber AS line, l_suppkey AS source_id, 'Supplier#' || l_partkey AS source_name FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 2 = 0 AND (s_suppkey = l_suppkey OR s_name = 'Supplier#' || l_partkey))
""")
def j14_unresolved_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("anchor"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source_id"), F.concat(F.lit("Supplier#"), "l_partkey").alias("source_name")
    )
    manifest = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return unresolved(anchors, manifest)


@query("""
SELECT o_orderkey AS chunk, o_custkey AS doc FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0
WHERE c_custkey IS NULL OR substr(o_orderpriority, 1, 1)::INT = c_custkey % 5
""")
def j15_current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document's current generation, and all of documents that record none."""
    durable = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 5).alias("generation"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("doc"), F.substring("o_orderpriority", 1, 1).cast("int").alias("own"))
    return chunks.join(durable, "doc", "left").where("generation IS NULL OR own = generation").select("chunk", "doc")


def host_policy(urls: DataFrame, allowed: Sequence[str], denied: Sequence[str]) -> DataFrame:
    """Decision on each URL: denied hosts first, then allowed ones, both with their subdomains; else not listed. Only https passes.

    Each host's suffixes meet the lists in an equi-join, so the lists may be large.
    """
    spark = urls.sparkSession
    lists = spark.createDataFrame([(h, "denied") for h in denied] + [(h, "allowed") for h in allowed], "suffix string, verdict string")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    hosts = urls.select("page_id", "url", host.alias("host"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(lists, "suffix").groupBy("host").agg(F.bool_or(F.col("verdict") == "denied").alias("denied"))
    decision = F.when(~F.col("url").startswith("https://"), "not_https").when(F.col("denied"), "denied").when(~F.col("denied"), "allowed").otherwise("not_listed")
    return hosts.join(met, "host", "left").select("page_id", "host", decision.alias("decision"))


@query(r"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, host, CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https'
  WHEN host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org') OR host = 'cheap-pills.example.com' OR ends_with(host, '.cheap-pills.example.com') THEN 'denied'
  WHEN host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org') THEN 'allowed' ELSE 'not_listed' END AS decision
FROM h
""")
def j16_host_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_policy(table(spark, sf_dir, "pages"), ("example.com", "example.org"), ("spam-farm.example.org", "cheap-pills.example.com"))


def first_fallback(asked: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """Each asked row's match in the first lookup that has one: (rows with ``id``, columns to match on)."""
    parts = [asked.join(rows, list(on)).select(key, "id", F.lit(i).alias("priority")) if on else asked.join(F.broadcast(rows.limit(1)), how="cross").select(key, "id", F.lit(i).alias("priority")) for i, (rows, on) in enumerate(lookups)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(key).agg(F.min(F.struct("priority", "id")).alias("best")).select(key, "best.priority", "best.id")


@query("""
WITH a AS (SELECT c_custkey AS asked, c_mktsegment AS intent, 'n' || c_nationkey AS domain, 'm' || c_custkey % 7 AS model FROM customer),
     v AS (SELECT o_orderkey AS id, c_mktsegment AS intent, CASE WHEN o_orderkey % 3 = 0 THEN 'general' ELSE 'n' || c_nationkey END AS domain, CASE WHEN o_orderkey % 5 = 0 THEN '*' ELSE 'm' || o_orderkey % 11 END AS model FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT asked, priority, id FROM (
  SELECT asked, priority, id, row_number() OVER (PARTITION BY asked ORDER BY priority, id) AS place FROM (
    SELECT asked, 0 AS priority, v.id FROM a JOIN v USING (intent, domain, model)
    UNION ALL SELECT asked, 1, v.id FROM a JOIN v ON a.intent = v.intent AND v.domain = 'general' AND a.model = v.model
    UNION ALL SELECT asked, 2, v.id FROM a JOIN v ON a.intent = v.intent AND a.domain = v.domain AND v.model = '*'
    UNION ALL SELECT asked, 3, v.id FROM a JOIN v ON a.intent = v.intent AND v.domain = 'general' AND v.model = '*'
    UNION ALL SELECT asked, 4, v.id FROM a JOIN (SELECT intent, min(id) AS id FROM v GROUP BY 1) v ON a.intent = v.intent)) WHERE place = 1
""")
def j17_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variation for intent, domain and model, else with the general domain, any model, both, and at last any of the intent."""
    customers = table(spark, sf_dir, "customer")
    asked = customers.select(F.col("c_custkey").alias("asked"), F.col("c_mktsegment").alias("intent"), F.concat(F.lit("n"), "c_nationkey").alias("domain"), F.concat(F.lit("m"), F.col("c_custkey") % 7).alias("model"))
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    domain = F.when(key % 3 == 0, "general").otherwise(F.concat(F.lit("n"), "c_nationkey"))
    model = F.when(key % 5 == 0, "*").otherwise(F.concat(F.lit("m"), key % 11))
    known = orders.join(customers, orders.o_custkey == customers.c_custkey).select(key.alias("id"), F.col("c_mktsegment").alias("intent"), domain.alias("domain"), model.alias("model"))
    # Only the smallest id of each key can win, so the fallback joins stay one to one.
    best = known.groupBy("intent", "domain", "model").agg(F.min("id").alias("id"))
    general, anywhere = F.col("domain") == "general", F.col("model") == "*"
    levels = [
        (best, ("intent", "domain", "model")),
        (best.where(general).drop("domain"), ("intent", "model")),
        (best.where(anywhere).drop("model"), ("intent", "domain")),
        (best.where(general & anywhere).drop("domain", "model"), ("intent",)),
        (best.groupBy("intent").agg(F.min("id").alias("id")), ("intent",)),
    ]
    return first_fallback(asked, levels, "asked")


@query("""
SELECT lock, run, source, n_name AS evidence FROM (SELECT o_orderkey AS run, unnest([o_custkey, o_custkey + 1]) AS lock FROM orders) l
JOIN (SELECT c_custkey, c_nationkey AS source FROM customer) ON c_custkey = lock JOIN nation ON n_nationkey = source
""")
def j18_lock_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source behind each lock of each run."""
    locks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.explode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("lock"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lock"), F.col("c_nationkey").alias("source"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("evidence"))
    return locks.join(sources, "lock").join(names, "source").select("lock", "run", "source", "evidence")


@query("""
SELECT user_id AS project_id, min(struct_pack(p := place, m := model)).m AS model FROM (
  SELECT user_id, nullif(CASE WHEN event_type IN ('view', 'click') THEN '' ELSE event_type END, '') AS model, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
WHERE place <= 20 AND model IS NOT NULL GROUP BY 1
""")
def j19_last_named_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest non-empty model among each project's last 20 rows."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    model = F.when(~F.col("event_type").isin("view", "click"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", model.alias("model"), F.row_number().over(newest).alias("place")).where("place <= 20 AND model IS NOT NULL")
    return rows.groupBy(F.col("user_id").alias("project_id")).agg(F.min_by("model", "place").alias("model"))


@query("""
SELECT s_suppkey AS source_id, s_name AS name, n AS carried, CASE WHEN n IS NULL THEN NULL ELSE s_suppkey % 3 <> n % 3 END AS changed_since_compile
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey
""")
def j20_source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with what a compile carried of them, and whether they changed since; null where nothing was carried."""
    plan = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count("*").alias("carried"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return sources.join(plan, "source_id", "left").select("source_id", "name", "carried", (F.col("source_id") % 3 != F.col("carried") % 3).alias("changed_since_compile"))
