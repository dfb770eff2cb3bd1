"""Trees of any depth, as JSON: walked level by level.

A document's body is an array of nodes, each with ``children`` of its own. A
level is a DataFrame of nodes with their paths; the next one explodes their
children. The trees are never recursed into by one row's expression, so depth
costs jobs and not stack, and a large tree's nodes are spread as soon as they
are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import written

MAX_DEPTH = 1000


#: What is read of a node, in one reading; an array's elements stay JSON.
_NODE = "id string, type string, children array<string>, annotations struct<redhat: array<string>>"


def _objects(elements: Column) -> Column:
    """The elements that are objects, in order."""
    return F.filter(elements, lambda e: F.ltrim(e).startswith("{"))


def walk(trees: DataFrame, key: str, json: str) -> DataFrame:
    """key, path (places from 0, from the body down), id, type and findings (how many are noted on it) of every node of ``trees``.

    Elements that are no objects are no nodes and take a place of their own
    kind only. Trees that are null, no JSON or without a body have no nodes.
    A node's JSON is read once, at its level, which is written with what the
    next one reads; columns that are not asked for are not read again.
    """
    body = _objects(F.from_json(json, "body array<string>")["body"])
    nodes = trees.select(key, F.posexplode(body).alias("place", "node")).select(key, F.array("place").alias("path"), "node")
    found = None
    for _ in range(MAX_DEPTH):
        findings = F.greatest(F.coalesce(F.size("n.annotations.redhat"), F.lit(0)), F.lit(0)).alias("findings")
        # Exploded, so that each node is read once and not once a column.
        read = nodes.select(key, "path", F.explode(F.array(F.from_json("node", _NODE))).alias("n"))
        level = written(read.select(key, "path", "n.id", "n.type", findings, _objects(F.col("n.children")).alias("children")))
        told = level.drop("children")
        found = told if found is None else found.unionByName(told)
        below = level.where(F.size("children") > 0)
        if below.isEmpty():
            return found
        nodes = below.select(key, "path", F.posexplode("children").alias("place", "node")).select(key, F.array_append("path", F.col("place")).alias("path"), "node")
    raise RuntimeError(f"trees deeper than {MAX_DEPTH}")


def all_nodes(walked: DataFrame, key: str) -> DataFrame:
    """Every node, sections too: key, path (joined by points; sorting paths gives the order of the document), depth, id, type."""
    return walked.select(key, F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), F.size("path").alias("depth"), "id", "type")


def node_counts(trees: DataFrame, walked: DataFrame, key: str) -> DataFrame:
    """How many nodes each tree has, whatever their depth, and findings noted on them."""
    counts = walked.groupBy(key).agg(F.count("*").alias("nodes"), F.sum(F.col("findings").cast("long")).alias("findings"))
    return trees.select(key).join(counts, key, "left").fillna(0, ["nodes", "findings"])


def block_nodes(walked: DataFrame, key: str) -> DataFrame:
    """The blocks of a document, its sections' own children that have an id: key, section and place in it, id, type."""
    named = walked.where((F.size("path") == 2) & (F.coalesce("id", F.lit("")) != ""))
    return named.select(key, F.col("path")[0].alias("section"), F.col("path")[1].alias("place"), "id", "type")


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as trees: orders are sections, lines are blocks, returned lines carry notes, notes on many pieces an answer."""
    lines = table(spark, sf_dir, "lineitem")
    answer = F.when(F.col("l_quantity") > 40, F.array(F.struct(F.lit("answer").alias("id"), F.lit("reply").alias("type"))))
    found = F.struct(F.array(F.struct(F.lit("open").alias("status"))).alias("redhat"))
    note = F.when(F.col("l_returnflag") == "R", F.array(F.struct(F.lit("note").alias("id"), F.lit("callout").alias("type"), found.alias("annotations"), answer.alias("children"))))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).otherwise("").alias("id"), F.lit("paragraph").alias("type"), note.alias("children"))
    blocks = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("children"))
    order = F.struct("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("section").alias("type"), "children")
    trees = table(spark, sf_dir, "orders").join(blocks, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("document_id")).agg(F.array_sort(F.collect_list(order)).alias("body"))
    return trees.select("document_id", F.to_json(F.struct("body")).alias("tree"))


_NODES = """
WITH s AS (SELECT o_custkey AS document_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
b AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS j FROM lineitem l),
m AS (SELECT document_id, i, j, CASE WHEN l_linestatus = 'O' THEN l_partkey::VARCHAR ELSE '' END AS id, l_returnflag = 'R' AS noted, l_quantity > 40 AS answered FROM s JOIN b ON l_orderkey = o_orderkey),
n AS (SELECT document_id, i::VARCHAR AS path, 1 AS depth, 'o' || o_orderkey AS id, 'section' AS type FROM s
  UNION ALL SELECT document_id, i || '.' || j, 2, id, 'paragraph' FROM m
  UNION ALL SELECT document_id, i || '.' || j || '.0', 3, 'note', 'callout' FROM m WHERE noted
  UNION ALL SELECT document_id, i || '.' || j || '.0.0', 4, 'answer', 'reply' FROM m WHERE noted AND answered)
"""


@query(_NODES + "SELECT * FROM n")
def n4_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of customers' trees with its path."""
    return all_nodes(walk(customer_trees(spark, sf_dir), "document_id", "tree"), "document_id")


@query(_NODES + "SELECT document_id, count(*) AS nodes, count(CASE WHEN depth = 3 THEN 1 END) AS findings FROM n GROUP BY 1")
def n5_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and findings of customers' trees."""
    trees = written(customer_trees(spark, sf_dir))
    return node_counts(trees, walk(trees, "document_id", "tree"), "document_id")


@query(_NODES + "SELECT document_id, i::INT AS section, j::INT AS place, id, 'paragraph' AS type FROM m WHERE id <> ''")
def n6_block_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of customers' trees."""
    return block_nodes(walk(customer_trees(spark, sf_dir), "document_id", "tree"), "document_id")
