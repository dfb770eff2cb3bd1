"""Tables of a data folder, and the operational tables that stand on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of every query that needs one, so that reruns agree.
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit log: id, action, success 0/1, project_id, details (JSON), created_at."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.upper("event_type").alias("action"),
        (F.col("event_type") != "error").cast("int").alias("success"),
        F.col("user_id").alias("project_id"),
        F.col("props").alias("details"),
        F.col("value"),
        F.col("ts").alias("created_at"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions of customers' documents: project_id, revision_id, status, size, created_at."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderkey").alias("revision_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("size"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )
