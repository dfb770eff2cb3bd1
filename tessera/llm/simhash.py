"""SimHash near-deduplication with deletion-variant signatures.

A fingerprint has 64 bits; two texts link when at most ``MAX_BITS`` = 4 of
them differ. Cut into three segments, two linked fingerprints have a segment
with at most one differing bit. So each segment is indexed once as it is and
once for each of its bits with that bit left out (a one-wildcard variant), and
fingerprints meet by equality of a variant: 3 + 64 index rows each.

A pair is judged in one variant only: in the first segment with at most one
differing bit, and there under the whole segment if it is equal, else under
the differing bit. Within a variant only spanning links of the verified pairs
are returned, so a group of near copies gives about as many links as it has
members. Variants with many fingerprints are cut into blocks and judged one
pair of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import connected_components
from tessera.llm.shared import bounded, fresh, met_by_key, read, stored

MAX_BITS = 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
SHINGLE_WORDS = 4
#: Fingerprints of one variant that a task compares with each other at once.
BLOCK = 2048
MAX_BROADCAST_ROWS = 100_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HASHES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 17


def fingerprint(text: str | None) -> int:
    """The text's SimHash, 0 for a text without words, as an unsigned number."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(SHINGLE_WORDS, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        spans = zip(starts[at : at + _HASHES_AT_ONCE].tolist(), ends[at : at + _HASHES_AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_fingerprints, schema)


def _variants(fps: DataFrame) -> DataFrame:
    """key and fp: the segments whole (upper part of key from 64 on) and with one bit left out (upper part: the bit)."""
    whole, less = [], []
    for number, (first, width) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        whole.append(F.lit((64 + number) << 22).bitwiseOR(segment))
        less += [F.lit((first + i) << 22).bitwiseOR(segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)))) for i in range(width)]
    return fps.select(F.explode(F.array(*whole, *less)).alias("key"), "fp")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """The masks of the segments, and for each upper part of a key its segment."""
    masks = np.array([((1 << w) - 1) << f for f, w in SEGMENTS], dtype=np.uint64)
    of = np.zeros(64 + len(SEGMENTS), dtype=np.int64)
    for number, (first, width) in enumerate(SEGMENTS):
        of[first : first + width] = number
        of[64 + number] = number
    return masks, of


def _link(kind: np.ndarray | int, differ: np.ndarray) -> np.ndarray:
    """Which differences make a link that is this variant's to find. kind: upper part of the key."""
    masks, of = _masks()
    kind = np.asarray(kind)
    good = np.bitwise_count(differ) <= MAX_BITS
    bit = np.minimum(kind, 63).astype(np.uint64)
    good &= np.where(kind >= 64, True, (differ >> bit) & np.uint64(1) == 1)
    for number in range(len(SEGMENTS) - 1):
        earlier = of[kind] > number
        good &= ~(earlier & (np.bitwise_count(differ & masks[number]) <= 1))
    return good


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links a-b connect, one for each node that isn't its group's smallest."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[left], least[right])
        new = least.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if (new == least).all():
            break
        least = new
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _large_run(kind: int, fps: np.ndarray, sides: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one key's fingerprints; if cross, only those between the two sides."""
    found_a, found_b = [], []
    left = fps[sides == 0] if cross else fps
    right = fps[sides == 1] if cross else fps
    step = max(1, _PAIRS_AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        i, j = np.nonzero(_link(kind, rows[:, None] ^ right[None, :]))
        a, b = rows[i], right[j]
        if len(a) > len(rows):
            a, b = _spanning(a, b)
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate(found_a or [fps[:0]]), np.concatenate(found_b or [fps[:0]])
    return _spanning(a, b) if len(a) else (a, b)


def _runs(key: np.ndarray, pair: np.ndarray, fps: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole runs of equal (key, pair)."""
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[run] <= 64
    small &= pair == 0
    kinds = (key >> 22).astype(np.int64)
    for gap in range(1, int(sizes.max(initial=0))):
        if gap >= 64:
            break
        same = np.flatnonzero((run[gap:] == run[:-gap]) & small[gap:])
        if not len(same):
            break
        good = same[_link(kinds[same], fps[same] ^ fps[same + gap])]
        yield fps[good], fps[good + gap]
    for r in np.flatnonzero((sizes > 1) & ~small[starts]):
        a, b = starts[r], starts[r] + sizes[r]
        yield _large_run(int(kinds[a]), fps[a:b], side[a:b], bool(pair[a] % 2))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows key, pair, fp, side that come sorted by key and pair; the last run waits for its end."""
    waiting: list[tuple[np.ndarray, ...]] = []

    def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        for a, b in _runs(*columns):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        key, pair, fp, side = (np.asarray(batch.column(i)) for i in range(4))
        if not len(key):
            continue
        fp = fp.astype(np.int64).view(np.uint64)
        last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if waiting and (cut or waiting[-1][0][-1] != key[0] or waiting[-1][1][-1] != pair[0]):
            yield from out([*waiting, (key[:cut], pair[:cut], fp[:cut], side[:cut])])
            waiting = []
        elif cut:
            yield from out([(key[:cut], pair[:cut], fp[:cut], side[:cut])])
        waiting.append((key[cut:], pair[cut:], fp[cut:], side[cut:]))
    if waiting:
        yield from out(waiting)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links a, b that connect all distinct fingerprints at most ``MAX_BITS`` bits apart."""
    variants = _variants(fps)
    crowded = stored(
        variants.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    if crowded.isEmpty():
        dealt = variants.select("key", F.lit(0).alias("pair"), "fp", F.lit(0).alias("side"))
    else:
        # A crowded key's fingerprints fall into blocks, and each block meets itself and every other once.
        # pair is 2 * number for a block with itself and odd for two blocks.
        placed = variants.join(bounded(crowded, MAX_BROADCAST_ROWS), "key", "left").withColumn(
            "block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        )
        meets = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda other: F.struct(
                F.when(other == F.col("block"), 2 * (F.col("block") + 1))
                .otherwise(2 * (F.least(other, F.col("block")) * F.col("blocks") + F.greatest(other, F.col("block"))) + 1)
                .alias("pair"),
                (other < F.col("block")).cast("int").alias("side"),
            ),
        )
        alone = F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))
        dealt = placed.select("key", F.explode(F.when(F.col("block").isNull(), alone).otherwise(meets)).alias("meet"), "fp").select(
            "key", "meet.pair", "fp", "meet.side"
        )
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_links, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long), component_id (the smallest id reachable over links).

    Equal texts have one fingerprint and so one component. Null and empty
    texts have fingerprint zero and link like any other; very long texts are
    read whole, like others. Null ids are passed
    over when the smallest is sought; a component of null ids only has a null
    one. Rows that repeat, ids too, are all returned. No rows give no rows;
    other columns are ignored.
    """
    known = stored(fingerprints(docs, id_col, text_col))
    distinct = stored(known.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")))
    nodes = connected_components(fingerprint_links(distinct.select("fp")))
    grouped = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"), "least_id", "copies")
    grouped = stored(grouped)
    least = stored(grouped.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")))
    of = stored(met_by_key(grouped, least, "component").select("fp", "component_id", F.col("copies").alias("n")))
    return met_by_key(known, of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, one row for each such id.

    Rows with a null id are kept: nothing names another that could stand for
    them. Null and empty texts are one group, like equal texts. Columns keep
    their names, whatever they are. No rows give no rows.
    """
    ident, place = fresh(docs, "kept_id"), fresh(docs, "kept_place")
    groups = near_dedup(docs, id_col, text_col)
    keep = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(ident)).distinct()
    first = Window.partitionBy(ident).orderBy(docs[text_col])
    kept = docs.join(keep, docs[id_col] == F.col(ident)).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
