"""Token ids in compressed binary files with a shared dictionary and an offset index.

A shard file holds, in this order and little-endian:

    magic      8 bytes, ``TSTOKENS``
    dictionary 32 bytes, SHA-256 of the zstandard dictionary, zeros without one
    width      u32, bytes of an id: 2 or 4
    documents  u32
    index      for each document: id i64, null flag u8, ids u64, end of its frame u64 (from the payload's start)
    payload    one zstandard frame for each document

One document is read by its index entry and one frame. The dictionary is
trained on the id arrays of a bounded sample and lies beside the shards.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bounded, checkpoint_dir, read, shuffle_partitions, stored

MAGIC = b"TSTOKENS"
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u8"), ("end", "<u8")])
HEAD = len(MAGIC) + 32 + 8
SHARD_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on so many documents, the first by a hash of their ids, and so many ids of each.
SAMPLE_DOCS = 2000
SAMPLE_IDS = 4096
LEVEL = 3
MAX_BROADCAST_ROWS = 100_000
#: Distinct words that a Python worker remembers the ids of: so many of the latest, and as many of those before them.
REMEMBERED = 280_000
REMEMBERED_CHARS = 64

#: A space between two characters that aren't white space.
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and the line feed, at its widest.
_RARE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that need the pattern above, and words that are encoded by themselves.
_CROWDED = rf"  | \n|\n |[{_RARE}]"
_ALONE = rf"^$|^\n|\n$|[ {_RARE}]"
_CHARS_AT_ONCE = 200_000
#: Texts are encoded together up to about so many bytes.
_BYTES_AT_ONCE = 2 << 20


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct word about once.

    A space between two characters that aren't white space always begins a
    new pre-token, so the text between two such spaces (a word, here) is
    encoded alike wherever it stands, and its ids are remembered. Words are
    split, told apart and put together again as arrays; only distinct new
    words reach the library.
    """

    def __init__(self, path: str) -> None:
        # A task has one core; threads of the library's own would compete with other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        #: Which tokens begin with a space, which the byte-level alphabet writes U+0120.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[n for token, n in vocabulary.items() if token[0] == "\u0120"]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _plain(self, units: list[str]) -> list[bytes]:
        """The ids of each unit by itself."""
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _after_space(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it.

        Words without white space at their ends or a space inside are encoded
        in one text, in which a token that begins with a space begins a word.
        """
        found: list[bytes] = [b""] * len(words)
        alone, joined, chars = [], [], 0

        def encode_joined() -> None:
            text = " " + " ".join([words[i] for i in joined])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * self.width
            data = ids.tobytes()
            for i, start, end in zip(joined, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found[i] = data[start:end]

        odd = pc.match_substring_regex(pa.array(words, pa.large_string()), _ALONE).to_pylist()
        for i, word in enumerate(words):
            if odd[i]:
                alone.append(i)
                continue
            joined.append(i)
            chars += len(word) + 1
            if chars >= _CHARS_AT_ONCE:
                encode_joined()
                joined, chars = [], 0
        if joined:
            encode_joined()
        for i, ids in zip(alone, self._plain([" " + words[i] for i in alone]), strict=True):
            found[i] = ids
        return found

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words with a space before them, from memory where they are known."""
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i in missing:
            found[i] = self.before.get(words[i])
        new = [i for i in missing if found[i] is None]
        for i, ids in zip(new, self._after_space([words[i] for i in new]), strict=True):
            found[i] = ids
        if len(self.known) >= REMEMBERED:
            self.known, self.before = {}, self.known
        self.known.update((words[i], found[i]) for i in missing if len(words[i]) <= REMEMBERED_CHARS)
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array without nulls, packed."""
        crowded = pc.match_substring_regex(texts, _CROWDED)
        order = np.concatenate([np.flatnonzero(~np.asarray(crowded)), np.flatnonzero(np.asarray(crowded))])
        split = [_SAFE_SPACE.split(t.as_py()) for t in texts.filter(crowded)]
        pieces = pa.chunked_array([pc.split_pattern(texts.filter(pc.invert(crowded)), " ").cast(_PIECES), pa.array(split, _PIECES)]).combine_chunks()
        starts = np.asarray(pieces.offsets)
        told = pieces.flatten().dictionary_encode()
        codes = np.asarray(told.indices).copy()
        words = told.dictionary.to_pylist()
        # A text's first word has no space before it: such words are further entries.
        heads, which = np.unique(codes[starts[:-1]], return_inverse=True)
        codes[starts[:-1]] = len(words) + which
        table = self._ids_of(words) + self._plain([words[i] for i in heads.tolist()])

        flat = np.frombuffer(b"".join(table), dtype=self.kind)
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // self.width
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        del pieces, told, words, table
        # The place in ``flat`` of each id of the output.
        shift = (np.cumsum(sizes) - sizes)[codes] - (ends - lengths)
        data = flat[np.repeat(shift, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        text_ends = ends[starts[1:] - 1] * self.width
        out: list[bytes] = [b""] * len(texts)
        start = 0
        for row, end in zip(order.tolist(), text_ends.tolist(), strict=True):
            out[row] = data[start:end]
            start = end
        return out


_PIECES = pa.large_list(pa.large_string())

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of that file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _groups(column: pa.Array) -> Iterator[pa.Array]:
    """The texts in groups of about ``_BYTES_AT_ONCE``, null as the empty text."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _BYTES_AT_ONCE, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def _encode_docs(path: str, end_id: int, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        squeeze = _compressor(dictionary)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                frames, counts = [], []
                for ids in enc.encode(texts):
                    counts.append(len(ids) // enc.width + 1)
                    frames.append(squeeze.compress(ids + end))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["id", "n", "frame"])
                at += len(texts)

    return run


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, **shared)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdDecompressor(**shared)


def _train(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> bytes:
    """A dictionary from a bounded sample; none if the library finds too little in it to learn from, as with few or tiny documents."""
    rows = docs.select(F.col(id_col).alias("some_id"), F.substring(text_col, 1, SAMPLE_IDS * 8).alias("head"))
    order = [F.xxhash64("some_id"), "some_id"]
    some = rows.select("some_id").orderBy(*order).limit(SAMPLE_DOCS)
    texts = rows.join(F.broadcast(some.distinct()), "some_id", "left_semi").orderBy(*order).limit(SAMPLE_DOCS)
    enc = encoder(path)
    most = SAMPLE_IDS * enc.width
    ids = texts.mapInArrow(_encode_docs(path, end_id, b""), "id long, n long, frame binary")
    plain = zstandard.ZstdDecompressor()
    samples = [plain.decompress(r.frame)[:most] for r in ids.select("frame").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes a file whole or not at all; a repeated attempt replaces it by the same bytes."""
    # Spark writes local URIs with one slash, pyarrow wants three.
    store, root = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
    store.create_dir(root, recursive=True)
    attempt = posixpath.join(root, f"_{name}.{uuid.uuid4().hex}")
    with store.open_output_stream(attempt) as out:
        out.write(data)
    store.move(attempt, posixpath.join(root, name))
    return name


def _write_shards(folder: str, width: int, digest: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple[int | None, int, bytes]] = []
        held = number = 0

        def shard() -> pa.RecordBatch:
            index = np.zeros(len(rows), dtype=INDEX)
            index["id"] = [r[0] or 0 for r in rows]
            index["null"] = [r[0] is None for r in rows]
            index["ids"] = [r[1] for r in rows]
            index["end"] = np.cumsum([len(r[2]) for r in rows])
            head = MAGIC + digest + np.array([width, len(rows)], dtype="<u4").tobytes()
            name = _put(folder, f"part-{part:06d}-{number:04d}.tok", head + index.tobytes() + b"".join(r[2] for r in rows))
            return pa.RecordBatch.from_pylist([{"shard": name, "docs": len(rows), "ids": int(index["ids"].sum())}])

        for batch in batches:
            for ident, n, frame in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows.append((ident.as_py(), n.as_py(), frame.as_py()))
                held += len(rows[-1][2]) + INDEX.itemsize
                if held >= SHARD_BYTES:
                    yield shard()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield shard()

    return run


def read_shard(data: bytes, dictionary: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """id, start within the shard and ids of each document of a shard file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    if data[len(MAGIC) : len(MAGIC) + 32] != _digest(dictionary):
        raise ValueError("written with another dictionary")
    width, count = np.frombuffer(data, dtype="<u4", count=2, offset=len(MAGIC) + 32).tolist()
    index = np.frombuffer(data, dtype=INDEX, count=count, offset=HEAD)
    payload = HEAD + index.nbytes
    expand = _decompressor(dictionary)
    at = start = 0
    for row in index.tolist():
        ids = np.frombuffer(expand.decompress(data[payload + at : payload + row[3]]), dtype=f"<u{width}")
        yield (None if row[1] else row[0]), start, ids
        at, start = row[3], start + row[2]


def _digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


def _read_shards(dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = [
                    {"id": ident, "shard": name.as_py(), "offset": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                    for ident, start, ids in read_shard(data.as_py(), dictionary)
                ]
                yield pa.RecordBatch.from_pylist(
                    rows, schema=pa.schema([("id", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
                )

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Writes ``docs`` into shard files in ``folder`` in ascending order of id; gives the shards with their starts, and the dictionary.

    ``folder`` is a URI that pyarrow can write to, shared by all machines.
    Each document's ids end with ``end_id``; a null or empty text gives that
    id alone; a text of any length is one frame. Null ids come first, rows
    with one id in order of their compressed ids. No rows give no shard files.
    Other columns are ignored, whatever their names.
    """
    enc = encoder(path)
    dictionary = _train(docs, path, end_id, id_col, text_col)
    _put(folder, "dictionary.zstd", dictionary)
    coded = stored(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_encode_docs(path, end_id, dictionary), "id long, n long, frame binary"))
    dealt = coded.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "frame")
    shards = stored(ordered.mapInArrow(_write_shards(folder, enc.width, _digest(dictionary)), "shard string, docs long, ids long"))
    # One row for each shard file, whose names are in the order of ids.
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("shard_start", F.coalesce(F.sum("ids").over(ahead), F.lit(0))), dictionary


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame, dictionary: bytes) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document in the files."""
    schema = "id long, shard string, offset long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = named.mapInArrow(_read_shards(dictionary), schema)
    starts = bounded(stored(shards.select("shard", "shard_start")), MAX_BROADCAST_ROWS)
    return rows.join(starts, "shard").select("id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    shards, dictionary = write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder, shards, dictionary).withColumnRenamed("id", "doc_id")
