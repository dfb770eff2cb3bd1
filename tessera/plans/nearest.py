"""Nearest vectors by cosine, exact, without comparing all with all.

Unit vectors fall into lists around centroids fitted to a bounded sample. A
query first searches its own list; the worst of what it found bounds what else
can matter. A list whose centre is farther from the query than that, by more
than the list's radius, holds nothing better and is left out; all others are
searched. Lists are cut into blocks of bounded size, and a block gives back a
query's best few only, so neither a list nor a label is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import bounded, written

#: Vectors that centroids are fitted to, vectors of a label for each list, lists at most, rounds of fitting, vectors of a block.
SAMPLE = 4096
LIST_SIZE = 256
MAX_LISTS = 256
FIT_ROUNDS = 8
BLOCK = 4096
MAX_BROADCAST_ROWS = 200_000
#: Scores are rounded to so many digits, and what could round up to a score is looked at.
DIGITS = 6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by rounds of assignment and means, from evenly spread members of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)]
    for _ in range(FIT_ROUNDS):
        home = _distances(sample, centroids).argmin(1)
        for n in np.unique(home).tolist():
            centroids[n] = sample[home == n].mean(0)
    return centroids


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0))


def _placed(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Unit vectors with their list and their distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _distances(_matrix(batch.column(2)), centroids)
            home = apart.argmin(1) if len(apart) else np.zeros(0, dtype=int)
            far = apart[np.arange(len(home)), home]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(home, pa.int32()), pa.array(far, pa.float64())], names=["id", "label", "v", "list", "far"])

    return run


def _probes(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with each list but their own and the distance of its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _distances(_matrix(batch.column(2)), centroids)
            many = len(centroids)
            rows = np.repeat(np.arange(len(apart)), many)
            lists = np.tile(np.arange(many, dtype=np.int32), len(apart))
            kept = lists != np.repeat(np.asarray(batch.column(3)), many)
            at = pa.array(rows[kept])
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(lists[kept]), pa.array(apart.reshape(-1)[kept])]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "label", "list", "apart"])

    return run


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best members of a block for each query that asks it; of equal scores the smaller ids."""

    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        names = ["label", "q", "other", "score"]
        if not asked.num_rows or not members.num_rows:
            return pa.table({"label": asked.column("label").slice(0, 0), "q": asked.column("q").slice(0, 0), "other": members.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        ids = np.asarray(members.column("id").combine_chunks())
        queries = np.asarray(asked.column("q").combine_chunks())
        scores = np.round(_matrix(asked.column("v").combine_chunks()) @ _matrix(members.column("v").combine_chunks()).T, DIGITS)
        scores[queries[:, None] == ids[None, :]] = -np.inf
        by_id = np.argsort(ids, kind="stable")
        order = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
        top = np.take_along_axis(scores, order, 1)
        rows, places = np.nonzero(np.isfinite(top))
        columns = [asked.column("label").take(pa.array(rows)), pa.array(queries[rows]), pa.array(ids[order[rows, places]]), pa.array(top[rows, places])]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """label, q, other, place and score of the k vectors of its label nearest to each query, itself left out.

    vectors and queries: id, label and v, arrays of one length without nulls,
    not zero; queries are rows of ``vectors``. Scores are cosines rounded to
    ``DIGITS`` digits; of equal ones the smaller ids come first.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select("id", "label", F.transform("v", lambda x: x / norm).alias("v"))
    sample = _matrix(unit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks())
    if not len(sample):
        return unit.select("label", F.col("id").alias("q"), F.col("id").alias("other"), F.lit(0).alias("place"), F.lit(0.0).alias("score"))
    largest = unit.groupBy("label").count().agg(F.max("count")).first()[0]
    centroids = _fit(sample, max(1, min(MAX_LISTS, round(largest / LIST_SIZE))))
    kinds = {c: unit.schema[c].dataType.simpleString() for c in ("id", "label")}
    placed = written(unit.mapInArrow(_placed(centroids), f"id {kinds['id']}, label {kinds['label']}, v array<double>, list int, far double"))
    asked = written(placed.join(queries.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("q"), "label", "v", "list"))
    lists = written(placed.groupBy("label", "list").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    sized = bounded(lists, MAX_BROADCAST_ROWS)
    members = placed.join(sized, ["label", "list"]).select("id", "label", "v", "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    out = f"label {kinds['label']}, q {kinds['id']}, other {kinds['id']}, score double"
    key = ["label", "list", "block"]

    def searched(probes: DataFrame) -> DataFrame:
        """The best of each block that ``probes`` (q, label, v, list) ask."""
        each = probes.join(sized, ["label", "list"]).select("q", "label", "v", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return each.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(_best(k), out)

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "other"))
    own = written(searched(asked).withColumn("place", place).where(F.col("place") <= k).drop("place"))
    worst = own.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
    far = asked.select("q", "label", "v", "list").mapInArrow(_probes(centroids), f"q {kinds['id']}, label {kinds['label']}, list int, apart double")
    # The nearest that a member of the list can be, as a cosine.
    least = F.greatest(F.lit(0.0), F.col("apart") - F.col("radius") - 1e-9)
    may = (1 - least * least / 2) >= F.coalesce("worst", F.lit(-2.0)) - 10.0**-DIGITS
    probes = far.join(sized, ["label", "list"]).join(worst, "q", "left").where(may).select("q", "list")
    more = searched(asked.select("q", "label", "v").join(probes, "q"))
    both = own.unionByName(more).withColumn("place", place).where(F.col("place") <= k)
    return both.select("label", "q", "other", "place", "score")


@query("""
SELECT label, vec_id, other, place, score FROM (
  SELECT a.label, a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS place
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE place <= 3
""")
def e_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of its label for every query, the rows whose id is divisible by 20, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return nearest(rows, rows.where("id % 20 = 0"), 3).withColumnRenamed("q", "vec_id")
