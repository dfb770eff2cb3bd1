"""Document quality by co-training.

Two views of a document: its text's content (hashed words and word shapes,
repetition) and its page's metadata and layout (language, source, length,
lines, shares of character classes). A logistic classifier for each view
starts from the labelled sample. In each round both score all documents in
Spark, and each view hands those that it is most confident about, with their
pseudo-labels, to the other; both are fitted again. Labelled documents held
out from training are split in two: the logistic combination that scores every
document is fitted to each part's rows as the other part calibrates them.

All documents' features are written once, packed, and every round reads them.
What classifiers are fitted to, labelled rows and those that gained a
pseudo-label, is a sample whose bounds are the constants below; it alone
reaches the driver. A document's features are summed by slot, so they are of
bounded size too, however long its text. Texts are not shuffled; the weights
that travel to the tasks have a fixed size.
"""

from __future__ import annotations

import operator
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from tessera.llm.shared import checkpoint_dir, read, stored

#: The most labelled rows that are fitted to, the first by a hash of the id.
LABELLED = 3000
#: Sources fall into so many groups by hash; of each, so many of all unlabelled documents are gathered in a round for each view and class, the surest first.
SOURCE_GROUPS = 64
GATHERED = 10
HELD_OUT = 4  # one in so many labelled documents calibrates or fits the combination, by turns
ROUNDS = 3
#: Pseudo-labels that a view hands over in a round, for each class.
EXCHANGED = 150
CONFIDENT = 0.95
#: The least chance of a pseudo-label by the view that learns it.
DOUBT = 0.5
THRESHOLD = 0.5

WORD_SLOTS = 1 << 13
SHAPE_SLOTS = 1 << 10
LANG_SLOTS, SOURCE_SLOTS, BINS = 32, 256, 16
TEXT_SIZE = WORD_SLOTS + SHAPE_SLOTS + 3
LAYOUT = ("chars", "lines", "line_length", "upper", "digits", "marks", "spaces")
META_SIZE = LANG_SLOTS + SOURCE_SLOTS + BINS * len(LAYOUT) + 1
STEPS = 120
RIDGE = 1e-4
_REMEMBERED = 300_000

_slots: dict[str, tuple[int, int]] = {}


def _word_slots(word: str) -> tuple[int, int]:
    """Slots of a word's letters and of its shape: case and the marks at its end."""
    if (found := _slots.get(word)) is None:
        body = word.rstrip("!?.,;:#$%&*|\"')")
        case = "U" if body.isupper() and len(body) > 1 else "T" if body[:1].isupper() else "l" if body.isalpha() else "o"
        shape = case + word[len(body) :][:4] if body else word[:4]
        found = crc32(body.lower().encode()) % WORD_SLOTS, WORD_SLOTS + crc32(shape.encode()) % SHAPE_SLOTS
        if len(_slots) >= _REMEMBERED:
            _slots.clear()
        _slots[word] = found
    return found


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the content view."""
    words = (text or "").split()
    counts = Counter(words)
    slots = np.array([_word_slots(w) for w in counts], dtype=np.int64).reshape(-1, 2)
    n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    total = max(1, len(words))
    plain = np.sqrt(n / total)
    shape_slots, place = np.unique(slots[:, 1], return_inverse=True)
    shapes = np.bincount(place, weights=n, minlength=len(shape_slots)) / total
    repeated = sum(map(operator.eq, words, words[1:])) / total
    rest = TEXT_SIZE - 3 + np.arange(3)
    idx = np.concatenate([slots[:, 0], shape_slots, rest])
    return idx, np.concatenate([plain, 3 * shapes, [3 * repeated, 3 * len(counts) / total, 1.0]])


def meta_view(text: str | None, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Slots, all with value 1, of the metadata view; a null lang, source or length has a slot of its own."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    size = max(1, len(data))
    classes = np.bincount(_CLASSES[data], minlength=5)
    lines = int((data == 10).sum()) + 1
    chars = -1.0 if n_chars is None or n_chars != n_chars else float(n_chars)
    values = [
        np.log2(chars + 1) if chars >= 0 else -1,
        np.log2(lines),
        np.log2(size / lines),
        *(BINS * (classes[c] / size) ** 0.5 for c in (1, 2, 3, 4)),
    ]
    bins = [LANG_SLOTS + SOURCE_SLOTS + BINS * i + int(min(BINS - 1, max(0, v + 1))) for i, v in enumerate(values)]
    lang_slot = crc32(lang.encode()) % (LANG_SLOTS - 1) if lang is not None else LANG_SLOTS - 1
    source_slot = crc32(source.encode()) % (SOURCE_SLOTS - 1) if source is not None else SOURCE_SLOTS - 1
    return np.array([lang_slot, LANG_SLOTS + source_slot, *bins, META_SIZE - 1], dtype=np.int64)


_CLASSES = np.zeros(256, dtype=np.int64)
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_CLASSES[[32, 9, 10, 11, 12, 13]] = 4


class Rows:
    """Sparse rows for fitting."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes = np.array([len(i) for i, _ in rows], dtype=np.int64)
        self.idx = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.ends = np.cumsum(self.sizes)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.val * weights[self.idx], self.ends - self.sizes) if len(self.sizes) else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, labels: np.ndarray, size: int, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights by Adam over all rows; the two classes weigh alike."""
    w = np.zeros(size) if start is None else start.copy()
    share = np.where(labels > 0.5, 0.5 / max(1, (labels > 0.5).sum()), 0.5 / max(1, (labels <= 0.5).sum()))
    m = v = np.zeros(size)
    for t in range(1, STEPS + 1):
        off = (_sigmoid(rows.dot(w)) - labels) * share
        g = np.bincount(rows.idx, weights=rows.val * np.repeat(off, rows.sizes), minlength=size) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _platt(x: np.ndarray, labels: np.ndarray, start: float = 0.0, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic fit to the columns of x and a constant, by Newton's method with steps halved where they overshoot; a ridge holds the columns' weights near ``start``."""
    x = np.column_stack([x, np.ones(len(x))])
    held = np.append(np.full(x.shape[1] - 1, start), 0.0)
    sign = 1 - 2 * labels

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, sign * (x @ w)).sum() + ridge / 2 * ((w - held) ** 2).sum())

    w = held.copy()
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - labels) + ridge * (w - held))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def _combined(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of both views' calibrated logits and a constant. Where few rows tell the views apart, both count alike; a view never counts against what it says."""
    w = _platt(logits, labels, 0.5, 1.0)
    for v in (0, 1):
        if w[v] < 0:
            other, constant = _platt(logits[:, [1 - v]], labels, 0.5, 1.0)
            w = np.array([other, 0.0, constant] if v else [0.0, other, constant])
    return w


class Model:
    """Weights of both views, their calibrations and their combination."""

    def __init__(self, labelled: list[tuple], labels: np.ndarray) -> None:
        """Classifiers of the labelled rows alone, as yet without calibration."""
        self.sizes = (TEXT_SIZE, META_SIZE)
        self.rows, self.labels = labelled, labels
        place = np.arange(len(labels))
        self.parts = [place % (2 * HELD_OUT) == 0, place % (2 * HELD_OUT) == HELD_OUT]
        # With too few labels to hold some of both classes out, all rows train, calibrate and combine.
        if any(len(set(labels[part])) < 2 for part in (*self.parts, ~(self.parts[0] | self.parts[1]))):
            self.parts = [np.ones(len(labels), bool)] * 2
            self.kept = np.ones(len(labels), bool)
        else:
            self.kept = ~(self.parts[0] | self.parts[1])
        train = [[r[v] for r, k in zip(labelled, self.kept, strict=True) if k] for v in (0, 1)]
        self.weights = [fit(Rows(train[v]), labels[self.kept], self.sizes[v]) for v in (0, 1)]

    def raw(self, rows: list[tuple]) -> list[np.ndarray]:
        """Chances by each view before calibration."""
        return [_sigmoid(Rows([r[v] for r in rows]).dot(self.weights[v])) for v in (0, 1)]

    def cotrain(self, gather: Callable[[Model, list], list[tuple]]) -> None:
        """Rounds of exchange, then calibration and combination.

        ``gather`` gives the ids and views of unlabelled documents that either
        view, as it stands, is sure about, without those already taken.
        """
        train = [[r[v] for r, k in zip(self.rows, self.kept, strict=True) if k] for v in (0, 1)]
        known = [self.labels[self.kept]] * 2
        taken: list = []
        for _ in range(ROUNDS):
            pool = gather(self, taken)
            if not pool:
                break
            chances = self.raw([row for _, row in pool])
            chosen: set[int] = set()
            for v, p in enumerate(chances):
                for label, sure, other in ((1.0, p, chances[1 - v]), (0.0, 1 - p, 1 - chances[1 - v])):
                    # A view teaches the other what that one is unsure of, not what it holds the opposite of.
                    best = [int(j) for j in np.argsort(-sure, kind="stable") if sure[j] >= CONFIDENT and other[j] >= DOUBT][:EXCHANGED]
                    train[1 - v] = train[1 - v] + [pool[j][1][1 - v] for j in best]
                    known[1 - v] = np.concatenate([known[1 - v], np.full(len(best), label)])
                    chosen |= set(best)
            taken += [pool[j][0] for j in sorted(chosen)]
            self.weights = [fit(Rows(train[v]), known[v], self.sizes[v], self.weights[v]) for v in (0, 1)]
        logits = [Rows([r[v] for r in self.rows]).dot(self.weights[v]) for v in (0, 1)]
        # The combination sees each held-out row as calibrated by the other part's rows.
        seen, answers = [], []
        for fitted, shown in (self.parts, self.parts[::-1]):
            self.calibration = [_platt(x[fitted][:, None], self.labels[fitted]) for x in logits]
            seen.append(np.column_stack([self._calibrated(v, x[shown]) for v, x in enumerate(logits)]))
            answers.append(self.labels[shown])
        self.combination = _combined(np.concatenate(seen), np.concatenate(answers))
        held = self.parts[0] | self.parts[1]
        self.calibration = [_platt(x[held][:, None], self.labels[held]) for x in logits]
        self.rows, self.labels = [], np.zeros(0)  # not needed to score

    def _calibrated(self, view: int, logit: np.ndarray) -> np.ndarray:
        a, b = self.calibration[view]
        return np.clip(a * logit + b, -12, 12)

    def score(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good quality by content, by metadata and by both."""
        own = [self._calibrated(v, Rows([r[v] for r in rows]).dot(self.weights[v])) for v in (0, 1)]
        both = np.column_stack([*own, np.ones(len(rows))]) @ self.combination
        return _sigmoid(own[0]), _sigmoid(own[1]), _sigmoid(both)


def views(text: str | None, lang: str | None, source: str | None, n_chars: float | None) -> tuple:
    slots = meta_view(text, lang, source, n_chars)
    return text_view(text), (slots, np.ones(len(slots)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """A model from labelled documents; None where the labels have fewer than two classes, as without any rows.

    A document's label is the rounded mean of its labels; null labels and ids
    are passed over. Of rows with one id the one whose content comes first by
    a hash is taken, and of equally sure documents the one whose id does, so
    reruns agree. Null and empty texts have no words; very long ones have as
    many features as others at most. Other columns are ignored, whatever their
    names.
    """
    mean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.avg(label_col).alias("label"))
    some = stored(mean.orderBy(F.xxhash64("l_id"), "l_id").limit(LABELLED))
    known = _fetched(docs, id_col, some)
    values = np.array([float(r.label >= 0.5) for r in known])
    if len(set(values.tolist())) < 2:
        return None
    features = _all_features(docs, id_col, some)
    model = Model([_unpacked(r) for r in known], values)
    spark, kind = docs.sparkSession, features.schema["l_id"]

    def gather(now: Model, taken: list) -> list[tuple]:
        used = F.broadcast(spark.createDataFrame([(i,) for i in taken], StructType([kind])))  # at most ROUNDS * 4 * EXCHANGED rows
        wanted = stored(_sure(features.join(used, "l_id", "left_anti"), now))
        found = _one_each(features.join(F.broadcast(wanted), "l_id", "left_semi"))
        return [(r.l_id, _unpacked(r)) for r in _in_order(found.collect())]

    model.cotrain(gather)
    return model


_PACKED = ("text_slots", "text_values", "meta_slots")


def _compact(made: tuple) -> tuple[bytes, bytes, bytes]:
    """Both views as bytes, the content's values summed by slot."""
    (slots, values), (meta, _) = made
    own, place = np.unique(slots, return_inverse=True)
    return own.astype("<u2").tobytes(), np.bincount(place, weights=values, minlength=len(own)).astype("<f4").tobytes(), meta.astype("<u2").tobytes()


def _unpacked(row) -> tuple:
    meta = np.frombuffer(row.meta_slots, dtype="<u2").astype(np.int64)
    return (np.frombuffer(row.text_slots, dtype="<u2").astype(np.int64), np.frombuffer(row.text_values, dtype="<f4").astype(np.float64)), (meta, np.ones(len(meta)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first columns of each row, and its text, lang, source and n_chars as packed features."""
    for batch in batches:
        kept = [c for c in batch.schema.names if c not in ("text", "lang", "source", "n_chars")]
        made = [_compact(views(*row)) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")), strict=True)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array([m[k] for m in made], pa.binary()) for k in range(3))], names=[*kept, *_PACKED])


def _with_features(rows: DataFrame) -> DataFrame:
    """``rows`` with text, lang, source and n_chars as packed features."""
    kept = [f for f in rows.schema.fields if f.name not in ("text", "lang", "source", "n_chars")]
    return rows.mapInArrow(_featured, StructType([*kept, *(StructField(c, BinaryType()) for c in _PACKED)]))


def _content() -> list[Column]:
    return [F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double").alias("n_chars")]


def _all_features(docs: DataFrame, id_col: str, labelled: DataFrame) -> DataFrame:
    """l_id, group of sources, a hash of the content and features of all unlabelled documents, written to the shared folder."""
    group = F.pmod(F.xxhash64(F.col("source")), F.lit(SOURCE_GROUPS)).alias("group")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), group, F.xxhash64("text", "lang", "source", "n_chars").alias("content"), *_content())
    path = f"{checkpoint_dir(docs.sparkSession)}/features-{uuid.uuid4().hex}"
    found = _with_features(rows.join(F.broadcast(labelled.select("l_id")), "l_id", "left_anti"))
    found.write.parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _chances(weights: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chances of good quality by each view, before calibration, of packed features."""

    def dot(slots: pa.Array, values: pa.Array | None, own: np.ndarray) -> np.ndarray:
        sizes = np.asarray(pc.binary_length(slots)).astype(np.int64) // 2
        found = own[np.frombuffer(b"".join(slots.to_pylist()), dtype="<u2")]
        if values is not None:
            found = found * np.frombuffer(b"".join(values.to_pylist()), dtype="<f4")
        return _sigmoid(np.add.reduceat(found, np.cumsum(sizes) - sizes)) if len(sizes) else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = dot(batch.column("text_slots"), batch.column("text_values"), weights[0]), dot(batch.column("meta_slots"), None, weights[1])
            yield pa.RecordBatch.from_arrays([batch.column("l_id"), batch.column("group"), pa.array(text), pa.array(meta)], names=["l_id", "group", "p_text", "p_meta"])

    return run


def _sure(features: DataFrame, model: Model) -> DataFrame:
    """l_id of the documents, of all, that either view is surest about in each group of sources: at most SOURCE_GROUPS * 4 * GATHERED rows."""
    schema = StructType([features.schema["l_id"], features.schema["group"], StructField("p_text", DoubleType()), StructField("p_meta", DoubleType())])
    rows = features.select("l_id", "group", *_PACKED).mapInArrow(_chances(model.weights), schema)
    chance = lambda name, label: F.col(name) if label else 1 - F.col(name)
    sides = (("p_text", "p_meta"), ("p_meta", "p_text"))
    sure = [F.struct(F.lit(2 * v + label).alias("what"), chance(own, label).alias("sure"), chance(other, label).alias("other")) for v, (own, other) in enumerate(sides) for label in (0, 1)]
    each = rows.select("l_id", "group", F.explode(F.array(*sure)).alias("s")).where((F.col("s.sure") >= CONFIDENT) & (F.col("s.other") >= DOUBT))
    first = Window.partitionBy("group", "s.what").orderBy(F.desc("s.sure"), F.xxhash64("l_id"), "l_id")
    return each.withColumn("place", F.row_number().over(first)).where(F.col("place") <= GATHERED).select("l_id").distinct()


def _gathered(docs: DataFrame, id_col: str, labelled: DataFrame, model: Model) -> DataFrame:
    """l_id of the unlabelled documents, of all, that either view is surest about in each group of sources."""
    return stored(_sure(_all_features(docs, id_col, labelled), model))


def _one_each(rows: DataFrame) -> DataFrame:
    """Of rows with one l_id that whose content comes first by a hash."""
    rest = [c for c in rows.columns if c not in ("l_id", "content")]
    return rows.groupBy("l_id").agg(F.min_by(F.struct(*rest), "content").alias("row")).select("l_id", "row.*")


def _in_order(rows: list) -> list:
    return sorted(rows, key=lambda r: (crc32(str(r.l_id).encode()), r.l_id))


def _fetched(docs: DataFrame, id_col: str, wanted: DataFrame) -> list:
    """Features and label of the wanted documents, one row for each id, in an order of their own."""
    rows = docs.select(F.col(id_col).alias("l_id"), F.xxhash64("text", "lang", "source", "n_chars").alias("content"), *_content())
    return _in_order(_with_features(_one_each(rows.join(F.broadcast(wanted), "l_id"))).collect())


def quality(model: Model | None) -> Column:
    """p_text, p_meta, score and accepted of a row with text, lang, source and n_chars.

    Without a model everything is accepted and the chances are null. Null and
    empty texts are scored as texts without words.
    """
    kind = "p_text double, p_meta double, score double, accepted boolean"
    if model is None:
        return F.struct(F.lit(None).cast("double").alias("p_text"), F.lit(None).cast("double").alias("p_meta"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("accepted"))

    @F.pandas_udf(kind)
    def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = list(zip(*columns, strict=True))
            parts = [model.score([views(*r) for r in rows[i : i + 256]]) for i in range(0, len(rows), 256)]
            text, meta, both = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            yield pd.DataFrame({"p_text": text, "p_meta": meta, "score": both, "accepted": both >= THRESHOLD})

    return scored(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("double"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model of ``labels`` accepts."""
    return docs.where(quality(train(docs, labels))["accepted"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality(model).alias("q")).select("doc_id", "q.p_text", "q.p_meta", "q.score", "q.accepted")
