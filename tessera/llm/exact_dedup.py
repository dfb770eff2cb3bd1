"""Exact deduplication by sorting content.

Texts are range-partitioned by sampled splitters over the head of their
normalised form and its digest, sorted outside memory within each partition,
so that equal texts become neighbours, and compared in full with their
neighbours. Splitters hold a bounded prefix and a digest, never whole texts,
so the driver's share does not grow with the length of documents.

A digest that holds more than ``1 / (HOT_SHARE * partitions)`` of all rows is
hot. There are at most ``HOT_SHARE * partitions`` of them, so the table of hot
digests is broadcast under that bound; each hot group is cut into runs of at
most that many rows, and the runs' first rows are merged afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, read, shuffle_partitions, single_spaced, stored, whole

HOT_SHARE = 8
PREFIX = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_hot: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one
    space. Of equal texts one row with the smallest id stays. A null text
    counts as empty; null ids come last, and a group of null ids only has a
    null keep_id and still keeps one row. Rows repeated whole count in
    group_size and only one of them is kept. No rows give no rows; other
    columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    texts = docs.select(F.col(id_col).alias("id"), single_spaced(whole(F.col(text_col))).alias("norm")).withColumn(
        "digest", F.sha2("norm", 256)
    )
    limit = max(least_hot, -(-docs.count() // (HOT_SHARE * parts)))
    counts = texts.groupBy("digest").agg(F.count("*").alias("n"))
    hot = stored(counts.where(F.col("n") > limit).select("digest", F.ceil(F.col("n") / limit).cast("int").alias("runs")))

    salted = texts.join(F.broadcast(hot), "digest", "left").select(
        "id",
        "norm",
        "digest",
        F.coalesce(F.pmod(F.xxhash64("id"), F.col("runs")), F.lit(-1)).alias("run"),
        F.substring("norm", 1, PREFIX).alias("prefix"),
    )
    # Window keys contain all range keys, so the sorted ranges serve the window as they are.
    run = Window.partitionBy("prefix", "digest", "run", "norm")
    first = run.orderBy(F.col("id").asc_nulls_last())
    runs = (
        salted.repartitionByRange(parts, "prefix", "digest", "run")
        .select(
            "id",
            "digest",
            "run",
            F.row_number().over(first).alias("place"),
            F.first("id").over(first).alias("run_id"),
            F.count("*").over(run).alias("run_size"),
            "norm",
        )
        .withColumn("norm", F.when((F.col("run") >= 0) & (F.col("place") == 1), F.col("norm")))
    )
    runs = stored(runs)
    # First rows of the runs of hot groups: at most 2 * HOT_SHARE * partitions rows.
    same = Window.partitionBy("digest", "norm")
    heads = runs.where("norm is not null").select(
        "digest",
        "run",
        F.first("id").over(same.orderBy(F.col("id").asc_nulls_last())).alias("group_id"),
        F.row_number().over(same.orderBy(F.col("id").asc_nulls_last())).alias("head"),
        F.sum("run_size").over(same).alias("total"),
    )
    merged = runs.drop("norm").join(F.broadcast(heads), ["digest", "run"], "left")
    return merged.select(
        F.col("id").alias(id_col),
        F.when(F.col("head").isNull(), F.col("run_id")).otherwise(F.col("group_id")).alias("keep_id"),
        F.coalesce("total", "run_size").cast("long").alias("group_size"),
        ((F.col("place") == 1) & (F.coalesce("head", F.lit(1)) == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows are fetched back by id and digest; of rows that share both, one
    stays. Null texts count as empty, null ids as one id that is larger than
    the others. Columns keep their names, whatever they are. No rows give no
    rows.
    """
    kept_key, place = fresh(docs, "kept_key"), fresh(docs, "kept_place")
    key = lambda ident, digest: F.concat_ws(":", digest, F.coalesce(ident.cast("string"), F.lit("null")))
    found = exact_dedup(docs, id_col, text_col)
    keep = found.where("kept").select(key(F.col(id_col), F.col("text_sha256")).alias(kept_key))
    # One string key serves the join and the window with one shuffle.
    keyed = docs.withColumn(kept_key, key(F.col(id_col), F.sha2(single_spaced(whole(F.col(text_col))), 256)))
    one = Window.partitionBy(kept_key).orderBy(kept_key)
    kept = keyed.join(keep, kept_key).withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return kept.select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
