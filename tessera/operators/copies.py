"""Appends to tables, copies between stores, and look-ups of listed rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import audit_log, table
from tessera.storage import checkpoint_dir

#: Listed ids up to this number are written into the filter, which reaches the scan; more are joined.
MAX_LISTED = 1000


def listed(rows: DataFrame, key: str, ids: Sequence | DataFrame) -> DataFrame:
    """The rows whose key is listed, once each however often it is; ``ids`` is a list or a DataFrame of one column."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.toDF(key).distinct(), key, "left_semi")
    if len(ids) <= MAX_LISTED:
        return rows.where(F.col(key).isin(list(ids)))
    wanted = rows.sparkSession.createDataFrame([(i,) for i in ids], rows.select(key).schema)
    return rows.join(wanted.distinct(), key, "left_semi")


@query("SELECT doc_id, source, n_chars FROM documents WHERE source <> 'src0' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s3_listed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed documents, as far as they belong to the asker's sources."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    rows = table(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id", "source", "n_chars")
    return listed(rows, "doc_id", ids)


def append(rows: DataFrame, folder: str) -> None:
    """Adds rows to a table; what is there stays."""
    rows.write.mode("append").parquet(folder)


@query("""
SELECT event_id AS id, upper(event_type) AS action, (event_type <> 'error')::INT AS success, user_id AS project_id FROM events
""")
def k1_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log to which successes and then failures are appended."""
    folder = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    log = audit_log(spark, sf_dir).select("id", "action", "success", "project_id")
    for outcome in (1, 0):
        append(log.where(F.col("success") == outcome), folder)
    return spark.read.schema(log.schema).parquet(folder)


def copy_tables(read: Callable[[str], DataFrame], folder: str, keys: Mapping[str, Sequence[str]]) -> None:
    """Copies tables into a store; rows whose key the store has already are left as they are there.

    ``read`` gives the source's table of a name. A copy that is cut short can
    be run again: keys written by it are passed over.
    """
    for name, key in keys.items():
        rows = read(name)
        target = f"{folder}/{name}"
        append(rows.limit(0), target)
        there = rows.sparkSession.read.schema(rows.schema).parquet(target).select(*key).distinct()
        append(rows.dropDuplicates(list(key)).join(there, list(key), "left_anti").select(*rows.columns), target)


@query("""
SELECT 'orders' AS name, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS state FROM orders
UNION ALL SELECT 'customer', c_custkey, c_mktsegment FROM customer
""")
def k9_copy_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables copied into a store that holds a third of the orders in another state, and copied once more."""
    folder = f"{checkpoint_dir(spark)}/copy-{uuid.uuid4().hex}"
    rows = {
        "orders": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")),
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state")),
    }
    append(rows["orders"].where("id % 3 = 0").withColumn("state", F.lit("X")), f"{folder}/orders")
    for _ in range(2):
        copy_tables(rows.__getitem__, folder, {name: ["id"] for name in rows})
    read = lambda name: spark.read.schema(rows[name].schema).parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), "id", "state")
    return read("orders").unionByName(read("customer"))


@query("""
WITH n AS (SELECT o_custkey AS document, o_orderkey AS node, o_totalprice > 50000 AS eligible FROM orders),
a AS (SELECT l_orderkey AS node, arg_min(l_suppkey, (l_linenumber, l_suppkey, l_returnflag)) AS source, arg_min(l_returnflag, (l_linenumber, l_suppkey, l_returnflag)) AS flag FROM lineitem WHERE l_discount > 0.02 GROUP BY 1),
i AS (SELECT n.*, a.source, s_suppkey IS NOT NULL AS known, CASE WHEN NOT eligible THEN 'not_a_claim' WHEN a.source IS NULL THEN 'unanchored' WHEN flag = 'N' THEN 'supported' WHEN flag = 'R' THEN 'contradicted' ELSE 'unverified' END AS state
  FROM n LEFT JOIN a USING (node) LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = a.source)
SELECT document, count(*) AS nodes, count(CASE WHEN eligible THEN 1 END) AS claims, count(source) AS anchors, count(CASE WHEN source IS NOT NULL AND known THEN 1 END) AS resolved,
  count(CASE WHEN state = 'supported' THEN 1 END) AS supported, count(CASE WHEN state = 'contradicted' THEN 1 END) AS contradicted, count(CASE WHEN state = 'unverified' THEN 1 END) AS unverified, count(CASE WHEN state = 'unanchored' THEN 1 END) AS unanchored FROM i GROUP BY 1
""")
def v21_bundle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every anchor of a bundle resolves against the manifest that it carries, and the states of its nodes."""
    index = node_index(spark, sf_dir)
    manifest = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source"), F.lit(True).alias("known"))
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    state = F.col("state")
    return index.join(manifest, "source", "left").groupBy("document").agg(
        F.count("*").alias("nodes"), count(F.col("eligible"), "claims"), F.count("source").alias("anchors"), count(F.col("known"), "resolved"),
        *[count(state == s, s) for s in ("supported", "contradicted", "unverified", "unanchored")],
    )


def node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each node: document, node, eligible, its first anchor's source and the state that was reached for it."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") > 50000).alias("eligible"))
    cited = table(spark, sf_dir, "lineitem").where("l_discount > 0.02")
    anchor = cited.groupBy(F.col("l_orderkey").alias("node")).agg(F.min(F.struct("l_linenumber", "l_suppkey", "l_returnflag")).alias("a"))
    flag = F.col("a.l_returnflag")
    state = F.when(~F.col("eligible"), "not_a_claim").when(F.col("a").isNull(), "unanchored").when(flag == "N", "supported").when(flag == "R", "contradicted").otherwise("unverified")
    return nodes.join(anchor, "node", "left").select("document", "node", "eligible", F.col("a.l_suppkey").alias("source"), state.alias("state"))


@query("""
WITH a AS (SELECT l_orderkey AS node, arg_min(l_suppkey, (l_linenumber, l_suppkey, l_returnflag)) AS source, arg_min(l_returnflag, (l_linenumber, l_suppkey, l_returnflag)) AS flag FROM lineitem WHERE l_discount > 0.02 GROUP BY 1)
SELECT o_custkey AS document, o_orderkey AS node, o_totalprice > 50000 AS eligible, source,
  CASE WHEN o_totalprice <= 50000 THEN 'not_a_claim' WHEN source IS NULL THEN 'unanchored' WHEN flag = 'N' THEN 'supported' WHEN flag = 'R' THEN 'contradicted' ELSE 'unverified' END AS state FROM orders LEFT JOIN a ON a.node = o_orderkey
""")
def v21_node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_index(spark, sf_dir)
