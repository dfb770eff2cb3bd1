"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key, ``-ln(u) / quality``: ordering a source
by that key is a weighted random order. A source's target is cut into complete
epochs, in which every document appears, and a rest, which the first documents
of the order fill. Documents are range-partitioned by source and key with
sampled splitters, so a large source spans many partitions however its keys
lie; prefix sums run within a source's share of a partition, on top of the
totals of its shares before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bounded, fresh, read, stored, whole, word_count

#: Largest number of hexadecimal digits of a digest that a double holds exactly.
DIGITS = 13
MAX_BROADCAST_ROWS = 100_000


def plain_quality(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: 1 where words and the gap after them take 6 characters on average, less the further from it."""
    per_word = F.length(text).cast("double") / size.cast("double")
    return F.when(size > 0, F.lit(1.0) / (F.lit(1.0) + F.abs(per_word - F.lit(6.0)) / F.lit(6.0))).otherwise(F.lit(1.0))


def exponential_key(ident: Column, quality: Column) -> Column:
    """``-ln(u) / quality`` with u in (0, 1) from the id's MD5, so that reruns agree."""
    digits = F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("null"))), 1, DIGITS), 16, 10).cast("double")
    return -F.ln((digits + F.lit(0.5)) / F.lit(float(16**DIGITS))) / quality


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Words that each source shall give: source, source_size, target.

    ``sizes`` has one row per source. Sources in code point order, null last,
    weigh ``weights`` in turn. The budget is ``share`` of all sizes; a source
    that reaches ``cap`` times its size stops, and its excess is shared again
    by weight. The level at which that ends has a closed form: with sources in
    order of the level that fills them, the level is the first that does not
    fill the next one.
    """
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("full_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    )
    by_level = everything.orderBy("full_at", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    leveled = ranked.withColumn("level", left / F.sum("weight").over(after))
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))
    level = F.min(fits).over(everything)["level"]
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce(level, F.col("full_at")) * F.col("weight"))
    return leveled.select("source", "source_size", "place", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, copies, source.

    size counts words (null text: 0) and taken is ``copies * size``. The words
    that a source gives differ from its target by at most half of one
    document's size. Sources may be null (a source of its own, last); a source
    without words has target 0 and keeps one copy of each document. Rows with
    one id share a key, and their order is settled by size; rows that repeat
    in full are interchangeable. No rows give no rows; other columns of
    ``docs`` are ignored.
    """
    slim = stored(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), whole(F.col(text_col)).alias("text"))
        .withColumn("size", word_count(F.col("text")))
        .withColumn("quality", plain_quality(F.col("text"), F.col("size")))
        .select("id", "source", "size", "quality", exponential_key(F.col("id"), F.col("quality")).alias("key"))
    )
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = stored(per_source)
    targets = source_targets(per_source.select("source", "source_size"), weights, share, cap)
    plan = (
        targets.alias("t")
        .join(per_source.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")))
        .select(
            F.col("t.source").alias("of"),
            F.col("place"),
            F.col("t.source_size").alias("source_size"),
            F.col("target"),
            F.when(F.col("t.source_size") > 0, F.floor(F.col("target") / F.col("t.source_size"))).otherwise(F.lit(1)).cast("long").alias("epochs"),
        )
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    plan = stored(plan)
    # Every task that reads a range reads the same rows of it, since the ranges are stored.
    ranged = stored(slim.repartitionByRange("source", "key", "id", "size").withColumn("slice", F.spark_partition_id()))
    slice_sums = ranged.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each source and each further partition that it spans.
    offsets = stored(slice_sums.select(F.col("source").alias("in"), F.col("slice").alias("in_slice"), F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("offset")))
    within = Window.partitionBy("source", "slice").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    begun = bounded(offsets.join(plan, F.col("in").eqNullSafe(F.col("of"))), MAX_BROADCAST_ROWS)
    summed = ranged.withColumn("within", F.sum("size").over(within)).join(begun, (F.col("slice") == F.col("in_slice")) & F.col("source").eqNullSafe(F.col("in")))
    # Taking the document that crosses the rest only if that ends nearer to it.
    middle = F.col("offset") + F.col("within") - F.col("size") / F.lit(2.0)
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (middle <= F.col("rest")), F.lit(1)).otherwise(F.lit(0))
    return summed.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        F.col("source").alias(source_col),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it.

    Rows that share an id take the largest number of copies of any of them;
    so do rows with a null id. Null and empty texts have no words and are
    taken once or as their source's epochs say. All columns come back,
    whatever their names. No rows give no rows.
    """
    ident, times, copy = (fresh(docs, name) for name in ("mixed_id", "mixed_copies", "mixed_copy"))
    copies = mix_sources(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias(ident)).agg(F.max("copies").alias(times))
    taken = docs.join(copies.where(F.col(times) > 0), docs[id_col].eqNullSafe(F.col(ident)))
    repeated = taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return repeated.select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / (CASE WHEN size > 0
                 THEN 1::DOUBLE / (1::DOUBLE + abs(length(text)::DOUBLE / size::DOUBLE - 6::DOUBLE) / 6::DOUBLE)
                 ELSE 1::DOUBLE END) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), r AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM s
), f AS (
  SELECT *, 2::DOUBLE * source_size / weight AS full_at FROM r
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM f
), t AS (
  SELECT source, source_size,
         least(2::DOUBLE * source_size,
               coalesce(first_value(CASE WHEN lvl <= full_at THEN lvl END IGNORE NULLS) OVER (
                 ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), full_at) * weight) AS target
  FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS epochs FROM t
), c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, k.source,
         e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING) - k.size / 2::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END)::BIGINT AS copies,
       source
FROM c
"""
