"""Helpers that several corpus operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import checkpoint_dir, stored

__all__ = ["SPACE_CLASS", "WORD_CLASS", "bounded", "checkpoint_dir", "fresh", "met_by_key", "read", "shuffle_partitions", "single_spaced", "stored", "whole", "word_count"]

#: White space of the corpus contracts: space and U+0009 to U+000D, nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


#: A key with more than 1 / (HOT_SHARE * partitions) of all rows is hot, if it has so many rows at least.
HOT_SHARE = 8
LEAST_HOT = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else left to a shuffled join.

    ``df`` should be cheap to count, such as a stored aggregate.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def met_by_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, which is stored and has one row a key, and in ``n`` how many of ``rows`` have it.

    Keys with more than one in ``HOT_SHARE * partitions`` of all rows meet their
    rows by broadcast, where these are; there are at most so many such keys,
    whatever the data. The others are shuffled.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    limit = max(LEAST_HOT, total // (HOT_SHARE * shuffle_partitions(rows.sparkSession)))
    hot = F.broadcast(table.where(F.col("n") > limit).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column, letters' case apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column) -> Column:
    """``text`` with null as the empty string."""
    return F.coalesce(text, F.lit(""))


def single_spaced(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space."""
    return F.regexp_replace(text, f"{SPACE_CLASS}+", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD_CLASS}+")).cast("long")
