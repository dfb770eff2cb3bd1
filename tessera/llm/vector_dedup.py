"""Embedding near-deduplication with an inverted-file product-quantisation index.

Coarse centroids and the residuals' subspace codebooks are trained on a
bounded sample; every vector is then indexed in the list of its nearest
centroid, apart for each label and dimension. A query looks into its own list
and those whose cell may hold a vector within the threshold: if q's nearest
centroid is h, a vector nearer to c than to h is at least
``(|q-c|^2 - |q-h|^2) / (2 |c-h|)`` away from q. All such lists are searched,
so no link is lost. Inside a list, distances are sums of table look-ups
(asymmetric: exact query, coded member); a member is passed over only if its
distance exceeds the threshold by more than its own coding error, and what is
left is ranked by the exact cosine in double precision.

Identical vectors of a label are one class with a size. Each list's task
returns sums and spanning links, never the pairs of a group; a crowded list is
cut into blocks of queries and members.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import bounded, read, stored
from tessera.llm.simhash import _spanning

LEAST_COSINE = 0.93
#: Vectors that centroids and codebooks are trained on, the first by a hash of their ids.
SAMPLE = 20_000
#: Classes of one label that a list shall hold, about, and the most centroids.
LIST_SIZE = 512
MAX_LISTS = 1024
SUBSPACES = 8
CODES = 256
BLOCK = 1024
PAIRS_AT_ONCE = 1 << 15
SEED = 7
MAX_BROADCAST_ROWS = 100_000


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids of the points, by Lloyd's rounds from k of them."""
    rng = np.random.default_rng(SEED)
    centroids = points[rng.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)[None, :], 0)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(points[i : i + 4096], centroids).argmin(1) for i in range(0, len(points), 4096)])


class Index:
    """Coarse centroids and subspace codebooks of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.dims = sample.shape[1]
        self.centroids = _kmeans(sample, lists)
        residuals = self._split(sample - self.centroids[_nearest(sample, self.centroids)])
        self.books = [_kmeans(residuals[:, s], CODES) for s in range(SUBSPACES)]

    def _split(self, residuals: np.ndarray) -> np.ndarray:
        """Residuals as (vectors, subspaces, dimensions), with zeros at the end."""
        width = -(-self.dims // SUBSPACES)
        padded = np.zeros((len(residuals), width * SUBSPACES))
        padded[:, : self.dims] = residuals
        return padded.reshape(len(residuals), SUBSPACES, width)

    def place(self, unit: np.ndarray, reach: float) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
        """Home list, lists to probe, codes and coding error of each vector."""
        squared = _squared(unit, self.centroids)
        home = squared.argmin(1)
        apart = np.sqrt(_squared(self.centroids, self.centroids))[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            margin = (squared - squared[np.arange(len(unit)), home][:, None]) / (2 * apart)
        margin[np.arange(len(unit)), home] = -1
        margin = np.where(np.isnan(margin), -1, margin)
        probes = [np.flatnonzero(row <= reach).tolist() for row in margin]
        residuals = self._split(unit - self.centroids[home])
        codes = np.stack([_nearest(residuals[:, s], self.books[s]) for s in range(SUBSPACES)], axis=1)
        decoded = np.stack([self.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
        return home, probes, codes.astype(np.uint8), np.sqrt(((residuals - decoded) ** 2).sum((1, 2)))

    def table(self, unit: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each query's residual in list ``at`` to every codeword: (subspaces, queries, codewords)."""
        residuals = self._split(unit - self.centroids[at])
        return np.stack([_squared(residuals[:, s], self.books[s]) if len(self.books[s]) == CODES else np.pad(_squared(residuals[:, s], self.books[s]), ((0, 0), (0, CODES - len(self.books[s])))) for s in range(SUBSPACES)])


def _units(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors at length one, with zeros up to ``dims``.

    Each is scaled by a power of two first, which rounds nothing, so that the
    squares of very small or large components neither vanish nor overflow.
    """
    raw = np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, initial=0, keepdims=True))[1])
    unit = np.zeros((len(raw), dims))
    unit[:, : raw.shape[1]] = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return unit


def _place(index: Index, reach: float) -> Callable:
    def run(batches):
        for batch in batches:
            for size in np.unique(np.asarray(batch.column("dims"))).tolist():
                part = batch.filter(pa.array(np.asarray(batch.column("dims")) == size))
                home, probes, codes, error = index.place(_units(part.column("embedding"), index.dims), reach)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("id", "label", "dims", "size", "embedding")),
                        pa.array(home, pa.int32()),
                        pa.array(probes, pa.list_(pa.int32())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(error),
                    ],
                    names=["id", "label", "dims", "size", "embedding", "home", "probes", "codes", "error"],
                )

    return run


def search_block(index: Index, at: int, queries: dict, members: dict, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) of one list with a cosine of at least ``least``, by position; each unordered pair once over all lists.

    If each of the two finds the other, in this list or the other one's, the
    one with the smaller id counts.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    table = index.table(queries["unit"], at)
    found_q, found_m = [], []
    rows = max(1, PAIRS_AT_ONCE * 8 // max(1, len(members["id"])))
    mutual_home = queries["home"]
    for start in range(0, len(queries["id"]), rows):
        stop = min(start + rows, len(queries["id"]))
        near = np.zeros((stop - start, len(members["id"])))
        for s in range(SUBSPACES):
            near += table[s, start:stop][:, members["codes"][:, s]]
        q, m = np.nonzero(near <= (reach + members["error"] + 1e-6) ** 2)
        q += start
        for i in range(0, len(q), PAIRS_AT_ONCE):
            a, b = q[i : i + PAIRS_AT_ONCE], m[i : i + PAIRS_AT_ONCE]
            good = np.einsum("ij,ij->i", queries["unit"][a], members["unit"][b]) >= least
            a, b = a[good], b[good]
            ida, idb = queries["id"][a], members["id"][b]
            back = members["probed"][b, mutual_home[a]]
            mine = (ida != idb) & (~back | (ida < idb))
            found_q.append(a[mine])
            found_m.append(b[mine])
    return np.concatenate(found_q or [np.zeros(0, int)]), np.concatenate(found_m or [np.zeros(0, int)])


def _columns(rows: pa.Table, index: Index, probed: bool) -> dict:
    out = {
        "id": rows.column("id").to_numpy(),
        "size": rows.column("size").to_numpy(),
        "home": rows.column("home").to_numpy(),
        "unit": _units(rows.column("embedding"), index.dims),
    }
    if probed:
        out["codes"] = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, SUBSPACES)
        out["error"] = rows.column("error").to_numpy()
        out["probed"] = np.zeros((rows.num_rows, len(index.centroids)), dtype=bool)
        for i, lists in enumerate(rows.column("probes").to_pylist()):
            out["probed"][i, lists] = True
    return out


def _search(index: Index, least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(query_rows: pa.Table, member_rows: pa.Table) -> pa.Table:
        if not query_rows.num_rows or not member_rows.num_rows:
            return schema.empty_table()
        queries, members = _columns(query_rows, index, False), _columns(member_rows, index, True)
        q, m = search_block(index, query_rows.column("list")[0].as_py(), queries, members, least)
        if not len(q):
            return schema.empty_table()
        ida, idb = queries["id"][q], members["id"][m]
        ids, place = np.unique(np.concatenate([ida, idb]), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([members["size"][m], queries["size"][q]]), minlength=len(ids)).astype(np.int64)
        a, b = _spanning(ida, idb)
        return pa.table([np.concatenate([ids, a]), pa.array([*[None] * len(ids), *b.tolist()], pa.int64()), pa.array([*sums.tolist(), *[0] * len(a)], pa.int64())], schema=schema)

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and embedding (doubles) of the rows that can link with anything."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they have equally
    many components and their cosine is at least ``least``. Null, empty and
    zero vectors and such with null or non-finite components link with
    nothing, and so does a row with a null id, whose component_id is null and
    which is kept. Identical vectors of a label all link with each other;
    repeated rows count among them. No rows give no rows; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col, label_col)
    members = stored(good.groupBy("label", "embedding").agg(F.min("id").alias("class"), F.count("*").alias("size")))
    classes = members.select(F.col("class").alias("id"), "label", F.size("embedding").alias("dims"), "size", "embedding")
    by_label = classes.groupBy("label").agg(F.max("dims").alias("dims"), F.count("*").alias("n"))
    shape = by_label.agg(F.max("dims").alias("dims"), F.max("n").alias("most")).first()
    of_class = good.join(members.select("label", "embedding", "class", "size"), ["label", "embedding"]).select("id", "class", "size")
    if shape.most:
        links, counts = _indexed_links(spark, classes, shape, least)
        grouped = connected_components(links)
        of_class = of_class.join(counts, F.col("class") == F.col("of"), "left").join(grouped, F.col("class") == F.col("node"), "left")
        of_class = of_class.select("id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    else:
        of_class = of_class.select("id", F.lit(0).cast("long").alias("n_links"), F.col("class").alias("component_id"))
    # Rows with one id and different vectors share a node.
    of_id = of_class.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("row_id"))
    return rows.join(of_id, F.col("row_id") == F.col("id"), "left").select(
        F.col("row_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "row_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
    )


def _indexed_links(spark: SparkSession, classes: DataFrame, shape, least: float) -> tuple[DataFrame, DataFrame]:
    """Spanning links a, b between classes, and for each class (of) the vectors linked with it beside its own copies."""
    sample = classes.select("id", "dims", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).drop("id").toArrow()
    units = [
        _units(part.column("embedding"), shape.dims)
        for size in np.unique(sample.column("dims").to_numpy()).tolist()
        for part in [sample.filter(pa.array(sample.column("dims").to_numpy() == size))]
    ]
    lists = min(MAX_LISTS, max(1, round(shape.most / LIST_SIZE)))
    index = Index(np.concatenate(units), lists)
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    schema = "id long, label string, dims int, size long, embedding array<double>, home int, probes array<int>, codes binary, error double"
    placed = stored(classes.mapInArrow(_place(index, reach), schema))

    queries = placed.select("id", "label", "dims", "size", "embedding", "home", F.explode("probes").alias("list"))
    held = placed.withColumn("list", F.col("home"))
    where = ["label", "dims", "list"]
    blocks = (
        held.groupBy(where)
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("member_blocks"))
        .join(queries.groupBy(where).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_blocks")), where)
    )
    blocks = bounded(stored(blocks), MAX_BROADCAST_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    asked = queries.join(blocks, where).select("*", block_of("query_blocks").alias("query_block"), every("member_blocks").alias("member_block"))
    asked = asked.drop("member_blocks", "query_blocks")
    told = held.join(blocks, where).select("*", block_of("member_blocks").alias("member_block"), every("query_blocks").alias("query_block"))
    told = told.drop("member_blocks", "query_blocks")
    told = told.toDF(*told.columns)  # columns of its own, since both sides come from one table
    key = [*where, "query_block", "member_block"]
    found = stored(asked.groupBy(key).cogroup(told.groupBy(key)).applyInArrow(_search(index, least), "a long, b long, links long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    return found.where("b is not null").select("a", "b"), counts


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
