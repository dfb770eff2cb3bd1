"""Phrase collocations by position bitmaps.

Texts are cut into shards of one language. In a shard each word has a bitmap of
its positions, kept as the gaps between set bits in a variable number of bytes;
a position without a word lies between two pieces, so nothing is found across
one.

A shard extends phrases depth-first: the bitmap of a phrase's ends, shifted by
one, is ANDed with the bitmaps of the words that may follow. These bitmaps are
disjoint, so one look-up of the shifted positions' words ANDs with all of them
at once, and the popcounts are the sizes of the groups that come out.

Popcounts are summed over all shards twice. First by a slot of the phrase's
hash, packed, for words, for pairs of words in frequent slots, and for longer
phrases along pairs in frequent slots. A slot's sum is at least that of each
phrase in it, so no frequent phrase is lost. Which slots are frequent goes back
to the shards as a bitmap of fixed size. Then the phrases of frequent slots,
few by now, are summed by their words, which gives exact counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bounded, checkpoint_dir, read, shuffle_partitions, stored

#: Text of one language that a shard holds, or one longer text.
SHARD_BYTES = 8 << 20
LONGEST = 5
#: Phrase occurrences that are extended together, depth-first before the next ones.
BATCH = 1 << 20
#: Popcounts are summed in so many slots, dealt by their highest bits into parts.
SLOT_BITS, PART_BITS = 31, 10
#: The bitmap of frequent slots has so many bits, one for each run of slots.
MAP_BITS = 24
#: Popcounts that a task holds before it packs them.
HELD = 1 << 21
#: A language's best phrases are sought in so many pieces first.
SALTS = 64
MAX_BROADCAST_ROWS = 200_000

#: A-Z in lower case, piece ends as line feeds, tabs as spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def pack_numbers(numbers: np.ndarray) -> np.ndarray:
    """Numbers as bytes, seven bits to a byte, the highest bit set where more follow."""
    sizes = np.ones(len(numbers), dtype=np.int64)
    for k in range(1, 9):
        sizes += numbers >= 1 << 7 * k
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        there = sizes > k
        out[starts[there] + k] = numbers[there] >> 7 * k & 127 | np.where(sizes[there] > k + 1, 128, 0)
    return out


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, starts)


def pack_bitmaps(positions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ascending positions of one word after the other as bytes, each as the gap from the one before it."""
    gaps = np.diff(positions, prepend=0)
    firsts = np.cumsum(counts) - counts
    gaps[firsts] = positions[firsts]
    return pack_numbers(gaps)


def unpack_bitmaps(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions that :func:`pack_bitmaps` has packed."""
    positions = np.cumsum(unpack_numbers(data))
    firsts = np.cumsum(counts) - counts
    return positions - np.repeat(np.where(firsts > 0, positions[firsts - 1], 0), counts)


def _shard(lang: str, texts: list[bytes]) -> pa.RecordBatch:
    """The distinct words of the texts with their occurrences and bitmaps, packed in one row; none without words."""
    data = np.frombuffer(b"\n".join(texts).translate(_PLAIN), dtype=np.uint8)
    texts.clear()
    inside = (data != 32) & (data != 10)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(inside) and inside[0]:
        starts = np.append(0, starts)
    offsets = np.append(np.cumsum(inside)[starts] - 1, inside.sum()) if len(starts) else np.zeros(1, dtype=np.int64)
    pieces = np.searchsorted(np.flatnonzero(data == 10), starts)
    positions = (np.arange(len(starts)) + np.cumsum(np.diff(pieces, prepend=pieces[:1]) != 0)).astype(np.int32)
    letters = data[inside]
    del data, inside, pieces, starts
    words = pa.LargeStringArray.from_buffers(len(positions), pa.py_buffer(offsets), pa.py_buffer(letters))
    told = words.dictionary_encode()
    del words, letters, offsets
    codes = np.asarray(told.indices)
    counts = np.bincount(codes, minlength=len(told.dictionary))
    bitmaps = pack_bitmaps(positions[np.argsort(codes, kind="stable")], counts)
    row = {"lang": lang, "n": len(positions), "words": b" ".join(told.dictionary.cast(pa.large_binary()).to_pylist()), "counts": pack_numbers(counts).tobytes(), "bitmaps": bitmaps.tobytes()}
    return pa.RecordBatch.from_pylist([row] if len(positions) else [], schema=_SHARD)


_SHARD = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("bitmaps", pa.binary())])


def _shards(shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts texts into shards of about so many bytes, a language each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1).cast(pa.binary())), strict=True):
                if not text:
                    continue
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= shard_bytes:
                    yield _shard(lang, held.pop(lang))
                    del sizes[lang]
                elif sum(sizes.values()) >= 2 * shard_bytes:
                    # Many languages: the largest goes as it is.
                    most = max(sizes, key=sizes.__getitem__)
                    yield _shard(most, held.pop(most))
                    del sizes[most]
        for lang, texts in held.items():
            yield _shard(lang, texts)

    return run


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Numbers spread evenly over 64 bits."""
    hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ hashes >> np.uint64(32)


def word_hashes(words: bytes, lang: str) -> np.ndarray:
    """A hash of each of the words, which single spaces divide, in a language: a polynomial of its bytes, for all of them at once."""
    data = np.frombuffer(words + b" ", dtype=np.uint8)
    base, back = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))
    powers = np.cumprod(np.full(len(data), base, dtype=np.uint64))
    ends = np.flatnonzero(data == 32)
    starts = np.append(0, ends[:-1] + 1)
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers))
    shift = np.cumprod(np.full(len(data), back, dtype=np.uint64))[starts]
    salt = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little"))
    return _mixed((sums[ends] - sums[starts]) * shift ^ _mixed(np.full(1, salt, dtype=np.uint64)))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _is_set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot is in a run of slots that the bitmap has set."""
    places = slots >> SLOT_BITS - MAP_BITS
    return bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1 == 1


class Shard:
    """A packed shard: its words, and which word each position holds."""

    def __init__(self, lang: str, words: bytes, counts: bytes, bitmaps: bytes, frequent: np.ndarray | None = None) -> None:
        self.lang, self.joined = lang, words
        self.hashes = word_hashes(words, lang)
        self.counts = unpack_numbers(np.frombuffer(counts, dtype=np.uint8))
        positions = unpack_bitmaps(np.frombuffer(bitmaps, dtype=np.uint8), self.counts)
        # Room behind the last position, so that shifted bitmaps stay inside.
        self.at = np.full(int(positions.max()) + 1 + LONGEST, -1, dtype=np.int32)
        self.at[positions] = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        if frequent is not None:
            rare = ~_is_set(frequent, _slots(self.hashes))
            self.at[np.append(rare, True)[self.at]] = -1

    def linked(self, frequent: np.ndarray | None = None) -> np.ndarray:
        """Bitmap of positions whose word and next word are kept, and are in a frequent slot as a pair."""
        both = np.append((self.at[:-1] >= 0) & (self.at[1:] >= 0), False)
        if frequent is not None:
            at = np.flatnonzero(both)
            both[at] = _is_set(frequent, _slots(self.phrase_hashes(at, 2)))
        return both

    def phrase_hashes(self, heads: np.ndarray, length: int) -> np.ndarray:
        """A hash of the phrase of ``length`` words at each start."""
        found = self.hashes[self.at[heads]]
        for k in range(1, length):
            found = _mixed(found * np.uint64(0x2545F4914F6CDD1D) + self.hashes[self.at[heads + k]])
        return found

    def grouped(self, starts: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of ``length`` words by their first ``length - 1`` words' groups: the starts in order of group, their groups, a start and the popcount of each."""
        keys = groups * len(self.counts) + self.at[starts + length - 1]
        order = np.argsort(keys, kind="stable")
        starts, keys = starts[order], keys[order]
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(np.append(heads, len(keys)))
        return starts, np.repeat(np.arange(len(heads)), counts), starts[heads], counts

    def pairs(self, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(linked)
        return self.grouped(starts, self.at[starts].astype(np.int64), 2)

    def extended(self, linked: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int, batch: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Depth-first: phrases, sorted by group, get each word that may follow, batch by batch of whole groups; gives length, starts and popcounts."""
        at = 0
        while at < len(starts):
            stop = len(starts) if len(starts) - at <= batch else int(np.searchsorted(groups, groups[at + batch], "left"))
            if stop <= at:
                stop = int(np.searchsorted(groups, groups[at], "right"))
            here, own = starts[at:stop], groups[at:stop]
            at = stop
            # The ends, shifted by one, at the words that may follow them.
            follows = linked[here + length - 2]
            here, own = here[follows], own[follows]
            if len(here):
                here, own, heads, counts = self.grouped(here, own, length)
                yield length, heads, counts
                if length < LONGEST:
                    yield from self.extended(linked, here, own, length + 1, batch)

    def longer(self, linked: np.ndarray, batch: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Phrases of three words and more that are chains of linked pairs."""
        starts, groups, _, _ = self.pairs(linked)
        yield from self.extended(linked, starts, groups, 3, batch)

    def spelled(self, heads: np.ndarray, length: int) -> pa.Array:
        words = pa.array(self.joined.split(b" "), pa.large_binary()).cast(pa.large_string())
        return pc.binary_join_element_wise(*[words.take(pa.array(self.at[heads + k])) for k in range(length)], pa.scalar(" ", pa.large_string()))


def _packed_sums(slots: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sums by slot, a row for each part: the gaps between its slots, and their counts."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    heads = np.flatnonzero(np.diff(slots, prepend=-1))
    counts, slots = np.add.reduceat(counts[order], heads) if len(heads) else counts, slots[heads]
    parts = slots >> SLOT_BITS - PART_BITS
    cuts = np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(parts)).tolist()
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        gaps = np.diff(slots[a:b], prepend=parts[a] << SLOT_BITS - PART_BITS)
        rows.append({"part": int(parts[a]), "gaps": pack_numbers(gaps).tobytes(), "counts": pack_numbers(counts[a:b]).tobytes()})
    yield pa.RecordBatch.from_pylist(rows, schema=_SUMS)


_SUMS = pa.schema([("part", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])
_PIECE = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
Popcounts = Iterator[tuple[np.ndarray, np.ndarray]]


def _summed(popcounts: Callable[[pa.RecordBatch], Popcounts], held_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Popcounts (hashes, counts) of a task's shards, summed by slot as far as it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            for hashes, counts in popcounts(batch):
                held.append((_slots(hashes), counts))
                rows += len(counts)
                if rows >= held_rows:
                    yield from _packed_sums(*map(np.concatenate, zip(*held, strict=True)))
                    held, rows = [], 0
        if rows:
            yield from _packed_sums(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _frequent_runs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of packed sums, sorted by part, as each part's piece of the bitmap of frequent slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SLOT_BITS - PART_BITS, dtype=np.int64)
        part = None

        def piece() -> pa.RecordBatch:
            runs = (sums.reshape(-1, 1 << SLOT_BITS - MAP_BITS) >= least).any(axis=1)
            return pa.RecordBatch.from_pylist([{"part": part, "bits": np.packbits(runs, bitorder="little").tobytes()}], schema=_PIECE)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield piece()
                    part = row["part"]
                    sums[:] = 0
                gaps, counts = (unpack_numbers(np.frombuffer(row[name], dtype=np.uint8)) for name in ("gaps", "counts"))
                sums[np.cumsum(gaps)] += counts
        if part is not None:
            yield piece()

    return run


def _bitmap(sums: DataFrame, least: int) -> np.ndarray:
    """The runs of slots that hold a frequent one, as a bitmap of 2 ** ``MAP_BITS`` bits, whatever the data."""
    dealt = sums.repartition(shuffle_partitions(sums.sparkSession), "part").sortWithinPartitions("part")
    pieces = dealt.mapInArrow(_frequent_runs(least), "part int, bits binary").collect()
    out = np.zeros(1 << MAP_BITS - 3, dtype=np.uint8)
    size = len(out) >> PART_BITS
    for row in pieces:
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for row in zip(*(batch.column(n) for n in names), strict=True):
        yield tuple(x.as_py() for x in row)


def _word_popcounts(batch: pa.RecordBatch) -> Popcounts:
    for lang, words, counts in _rows(batch, "lang", "words", "counts"):
        yield word_hashes(words, lang), unpack_numbers(np.frombuffer(counts, dtype=np.uint8))


_PACKED = ("lang", "words", "counts", "bitmaps")


def _pair_popcounts(words: np.ndarray) -> Callable[[pa.RecordBatch], Popcounts]:
    def run(batch: pa.RecordBatch) -> Popcounts:
        for row in _rows(batch, *_PACKED):
            shard = Shard(*row, words)
            _, _, heads, counts = shard.pairs(shard.linked())
            yield shard.phrase_hashes(heads, 2), counts

    return run


def _longer_popcounts(words: np.ndarray, pairs: np.ndarray, batch_rows: int) -> Callable[[pa.RecordBatch], Popcounts]:
    def run(batch: pa.RecordBatch) -> Popcounts:
        for row in _rows(batch, *_PACKED):
            shard = Shard(*row, words)
            for length, heads, counts in shard.longer(shard.linked(pairs), batch_rows):
                yield shard.phrase_hashes(heads, length), counts

    return run


def _spelled(words: np.ndarray, pairs: np.ndarray, longer: np.ndarray, batch_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The phrases of frequent slots, spelled out, with each shard's popcounts: a row for each part, a line for each phrase."""

    def found(shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        firsts = np.zeros(len(shard.counts), dtype=np.int64)
        there = np.flatnonzero(shard.at >= 0)
        firsts[shard.at[there]] = there
        kept = np.unique(shard.at[there])
        yield 1, firsts[kept], shard.counts[kept]
        linked = shard.linked(pairs)
        _, _, heads, counts = shard.pairs(linked)
        yield 2, heads, counts
        for length, heads, counts in shard.longer(linked, batch_rows):
            often = _is_set(longer, _slots(shard.phrase_hashes(heads, length)))
            yield length, heads[often], counts[often]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch, *_PACKED):
                shard = Shard(*row, words)
                each = [(_slots(shard.phrase_hashes(heads, length)), shard.spelled(heads, length), counts) for length, heads, counts in found(shard)]
                parts, counts = (np.concatenate([e[k] for e in each]) for k in (0, 2))
                parts >>= SLOT_BITS - PART_BITS
                order = np.argsort(parts, kind="stable")
                phrases = pa.concat_arrays([e[1] for e in each]).take(pa.array(order)).to_pylist()
                cuts = np.append(np.flatnonzero(np.diff(parts[order], prepend=-1)), len(order)).tolist()
                rows = [{"part": int(parts[order[i]]), "lang": shard.lang, "phrases": "\n".join(phrases[i:j]), "counts": pack_numbers(counts[order[i:j]]).tobytes()} for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_pylist(rows, schema=_LINES)

    return run


_LINES = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.string()), ("counts", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])


def _exact(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of phrases, sorted by part and language, summed by phrase; the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        now = None

        def frequent() -> pa.RecordBatch:
            kept = [(phrase, n) for phrase, n in sums.items() if n >= least]
            columns = [[now[1]] * len(kept), [p for p, _ in kept], [p.count(" ") + 1 for p, _ in kept], [n for _, n in kept]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)

        for batch in batches:
            for part, lang, phrases, counts in _rows(batch, "part", "lang", "phrases", "counts"):
                if (part, lang) != now:
                    if now is not None:
                        yield frequent()
                    now = part, lang
                    sums = {}
                for phrase, n in zip(phrases.split("\n"), unpack_numbers(np.frombuffer(counts, dtype=np.uint8)).tolist(), strict=True):
                    sums[phrase] = sums.get(phrase, 0) + n
        if now is not None:
            yield frequent()

    return run


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def phrase_counts(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The occurrences of frequent phrases, and of all words.

    Gives (lang, phrase, k, f) of every phrase of one to five words that
    occurs ``least`` times or more in its language, and (lang, n) of all words.
    """
    folder = f"{checkpoint_dir(docs.sparkSession)}/phrases-{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = _written(texts.mapInArrow(_shards(SHARD_BYTES), "lang string, n long, words binary, counts binary, bitmaps binary"), folder)
    totals = stored(shards.groupBy("lang").agg(F.sum("n").alias("n")))
    packed = shards.select(*_PACKED)
    sums = "part int, gaps binary, counts binary"
    words = _bitmap(shards.select("lang", "words", "counts").mapInArrow(_summed(_word_popcounts, HELD), sums), least)
    pairs = _bitmap(packed.mapInArrow(_summed(_pair_popcounts(words), HELD), sums), least)
    longer = _bitmap(packed.mapInArrow(_summed(_longer_popcounts(words, pairs, BATCH), HELD), sums), least)
    lines = packed.mapInArrow(_spelled(words, pairs, longer, BATCH), "part int, lang string, phrases string, counts binary")
    dealt = lines.repartition(shuffle_partitions(docs.sparkSession), "part", "lang").sortWithinPartitions("part", "lang")
    return stored(dealt.mapInArrow(_exact(least), "lang string, phrase string, k int, f long")), totals


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of two to five words.

    Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]``
    and into words at spaces and tabs. A phrase is a candidate if it occurs
    ``least`` times within pieces of its language, overlaps included. It is
    cut where the score floor(1000 * a * n / (l * r)) is least, first of equal
    ones, where a, l and r are the occurrences of it and its parts, and n
    those of all words. A candidate inside a longer phrase that occurs as
    often is dropped. The rest are ranked by score, a, and the phrase's bytes.

    A null language counts as ``und``; null and empty texts have no words;
    repeated rows and ids count again each; a text of any length is read
    whole, by one task. Other columns are ignored, whatever their names. No
    rows or no candidates give no rows. Arithmetic is on decimals of 38 places.
    """
    counts, totals = phrase_counts(docs, least, lang_col, text_col)
    candidates = counts.where("k >= 2").select("lang", "phrase", F.split("phrase", " ").alias("words"), "k", F.col("f").alias("a"))

    # A phrase that occurs as often as one a word longer is dropped; one yet longer implies one a word longer.
    inner = F.explode(F.array(F.expr("slice(words, 1, k - 1)"), F.expr("slice(words, 2, k - 1)")))
    wider = candidates.where("k >= 3").select(F.col("lang").alias("i_lang"), inner.alias("inner"), "a")
    widest = wider.groupBy("i_lang", _joined(F.col("inner")).alias("i_phrase")).agg(F.max("a").alias("as_often"))
    inside = (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")) & (F.col("as_often") >= F.col("a"))
    kept = candidates.join(bounded(stored(widest), MAX_BROADCAST_ROWS), inside, "left_anti")

    cuts = kept.select("lang", "phrase", "words", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    parts = cuts.select("lang", "phrase", "a", "cut", _joined(F.expr("slice(words, 1, cut)")).alias("left"), _joined(F.expr("slice(words, cut + 1, k - cut)")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        own = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        parts = parts.join(bounded(own, MAX_BROADCAST_ROWS), ["lang", side])
    exact = [f"cast({c} as decimal(19, 0))" for c in ("a", "n", "l", "r")]
    score = F.expr("(cast(1000 as decimal(4, 0)) * {} * {}) div ({} * {})".format(*exact)).cast("long")
    scored = parts.join(bounded(totals, MAX_BROADCAST_ROWS), "lang").withColumn("score", score)
    least_cut = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, w[i:i + k - 1] AS words, count(*) AS f FROM starts, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, words, f AS a, array_to_string(words, ' ') AS phrase FROM grams WHERE len(words) >= 2),
longer AS (
    SELECT lang, words[i:j] AS words, max(a) AS most
    FROM candidates, range(1, 6) AS x(i), range(1, 6) AS y(j) WHERE i < j AND j <= len(words) AND j - i + 1 < len(words) GROUP BY ALL
),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer g ON c.lang = g.lang AND c.words = g.words WHERE g.most IS NULL OR 100 * g.most < 100 * c.a),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM kept c JOIN range(1, 5) AS q(k) ON k < len(c.words) JOIN grams x ON x.lang = c.lang AND x.words = c.words[1:k]
    JOIN grams y ON y.lang = c.lang AND y.words = c.words[k + 1:] JOIN totals t ON t.lang = c.lang
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
