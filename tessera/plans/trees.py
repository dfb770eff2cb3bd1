"""Document trees of sections and leaves as nested structs: flattening, walking, splicing, indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as documents: body is an array of sections (orders) with children (order lines)."""
    leaf = F.struct(F.col("l_linenumber").alias("id"), F.when(F.col("l_returnflag") == "R", "table").otherwise("paragraph").alias("type"), F.col("l_quantity").cast("string").alias("content"))
    sections = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(leaf)).alias("children"))
    orders = table(spark, sf_dir, "orders").join(sections, "o_orderkey")
    section = F.struct(F.col("o_orderkey").alias("id"), F.lit("section").alias("type"), F.col("o_orderpriority").alias("title"), "children")
    return orders.groupBy(F.col("o_custkey").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", section.alias("s")))).alias("b")).select("document_id", F.transform("b", lambda x: x["s"]).alias("body"))


def flatten_nodes(body: Column) -> Column:
    """The leaves of all sections, with their section's id."""
    return F.flatten(F.transform(body, lambda s: F.transform(s["children"], lambda c: F.struct(s["id"].alias("section"), c["id"].alias("id"), c["type"].alias("type"), c["content"].alias("content")))))


def splice(body: Column, section: Column, leaf: Column, content: Column) -> Column:
    """The body with one leaf's content replaced."""
    return F.transform(
        body,
        lambda s: F.struct(
            s["id"].alias("id"),
            s["type"].alias("type"),
            s["title"].alias("title"),
            F.transform(s["children"], lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), F.when((s["id"] == section) & (c["id"] == leaf), content).otherwise(c["content"]).alias("content"))).alias("children"),
        ),
    )


@query("""
SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'paragraph' END, l_quantity::VARCHAR) - 1 AS position, o_orderkey AS section, l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'paragraph' END AS type
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def n1_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of each document with its place."""
    rows = documents_of(spark, sf_dir).select("document_id", F.posexplode(flatten_nodes(F.col("body"))).alias("position", "n"))
    return rows.select("document_id", F.col("position").cast("long").alias("position"), "n.section", "n.id", "n.type")


@query("""
SELECT o_custkey AS document_id, count(DISTINCT o_orderkey) + count(*) AS nodes, count(DISTINCT o_orderkey) AS sections, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS tables FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def n2_walk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each document, sections among them, and its tables, without exploding the tree."""
    children = F.flatten(F.transform("body", lambda s: s["children"]))
    tables = F.filter(children, lambda c: c["type"] == "table")
    long = lambda c, name: c.cast("long").alias(name)
    return documents_of(spark, sf_dir).select("document_id", long(F.size("body") + F.size(children), "nodes"), long(F.size("body"), "sections"), long(F.size(tables), "tables"))


@query("""
SELECT o_custkey AS document_id, count(CASE WHEN o_orderkey = fo AND l_linenumber = 1 THEN 1 END) AS replaced FROM (
  SELECT o_custkey, o_orderkey, l_linenumber, min(o_orderkey) OVER (PARTITION BY o_custkey) AS fo FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1
""")
def n3_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leaves a replacement of the first section's first leaf changes."""
    docs = documents_of(spark, sf_dir)
    after = docs.withColumn("after", splice(F.col("body"), F.get("body", F.lit(0))["id"], F.lit(1), F.lit("rewritten")))
    changed = F.filter(flatten_nodes(F.col("after")), lambda n: n["content"] == "rewritten")
    return after.select("document_id", F.size(changed).cast("long").alias("replaced"))
