"""Byte-level BPE over a global shuffle of distinct words.

Documents are cut into blocks. A block explodes its texts into pre-tokens with
positions, keeps each distinct word once, and writes every document as the
sequence of its words' ranks by frequency, so a position costs little over a
byte. The words leave the block grouped by a hash of the word: equal words of
all blocks meet in one bucket, where each is encoded once as the rows stream
past in order of bucket. The buckets' ids are joined back by block, and every
document is put together again by position.

Words travel packed, a row for each block and bucket, since a row for each
word or position would move several times the text. There are as many buckets
as shuffle partitions, whatever the input, so rows grow with the blocks alone. Sequences and words come
from two readings of the documents: reading twice is cheaper than a copy of
the sequences in the shared folder. A block is named after its content, and
putting it together fails if the two readings disagree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, shuffle_partitions

#: A block ends after so many characters or documents.
BLOCK_CHARS = 6_000_000
BLOCK_DOCS = 20_000
LEVEL = 3
#: Words of a bucket whose ids a task remembers: so many of the latest, and as many of those before them.
REMEMBERED = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordBpe:
    """Encodes single words by ranks, and decodes ids by the token-byte table."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = load_ranks(path)
        # The pattern takes a word whole: it is one match of the pre-token pattern already.
        self.encoding = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, word: str) -> list[int]:
        return self.encoding.encode_ordinary(word)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """The worker's coder of that file."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def _pack(arrays: list[bytes]) -> bytes:
    """Byte strings in one frame: their number, their lengths, and all of them."""
    lengths = np.array([len(arrays), *map(len, arrays)], dtype="<u4")
    return zstandard.ZstdCompressor(level=LEVEL).compress(lengths.tobytes() + b"".join(arrays))


def _unpack(frame: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    count = int(np.frombuffer(data, dtype="<u4", count=1)[0])
    ends = (np.cumsum(np.frombuffer(data, dtype="<u4", count=count, offset=4)) + 4 + 4 * count).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * count, *ends], ends, strict=False)]


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as a frame of their four bytes, each byte's plane by itself, since low planes alone carry much."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def _unpack_numbers(frame: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


class _Numbers(dict):
    """Words numbered as they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Documents, their pre-tokens numbered as first seen, and a checksum of it all."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.numbers = _Numbers()
        self.chars = self.check = 0

    def add(self, ident: int | None, text: str, found: list[str]) -> None:
        self.ids.append(ident)
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int32, count=len(found)))
        self.chars += len(text)
        self.check = crc32(text.encode(), crc32(str(ident).encode(), self.check))

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """All codes as ranks by frequency, and each number's rank."""
        codes = np.concatenate(self.codes)
        order = np.argsort(-np.bincount(codes, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return rank[codes], rank


def _blocks(pattern: str, make: Callable[[str, _Block], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        part, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = text.as_py() or ""
                block.add(ident.as_py(), whole, find(whole))
                if block.chars >= BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS:
                    yield make(f"{part}-{number}-{block.check}", block)
                    number, block = number + 1, _Block()
        if block.ids:
            yield make(f"{part}-{number}-{block.check}", block)

    return run


def _sequences(name: str, block: _Block) -> pa.RecordBatch:
    """The block's documents as ranks of words."""
    schema = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary())])
    row = {"block": name, "ids": block.ids, "lengths": [len(c) for c in block.codes], "codes": _pack_numbers(block.ranked()[0])}
    return pa.RecordBatch.from_pylist([row], schema=schema)


def _words(buckets: int) -> Callable[[str, _Block], pa.RecordBatch]:
    """The block's distinct words with their ranks, a row for each bucket."""
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("ranks", pa.binary()), ("words", pa.binary())])

    def make(name: str, block: _Block) -> pa.RecordBatch:
        rank = block.ranked()[1]
        groups: dict[int, list[tuple[bytes, int]]] = {}
        for raw, r in zip((w.encode() for w in block.numbers), rank.tolist(), strict=True):
            groups.setdefault(crc32(raw) % buckets, []).append((raw, r))
        rows = []
        for bucket, group in groups.items():
            group.sort()  # neighbours alike compress well
            rows.append({"block": name, "bucket": bucket, "ranks": _pack_numbers(np.array([r for _, r in group])), "words": _pack([w for w, _ in group])})
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    return make


def _encode_buckets(path: str, remembered: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes the words of rows sorted by bucket, each distinct word of a bucket once; gives every block's words' ids in the block's order.

    A task holds a row and the ids of the bucket's words; of a bucket with more
    than ``remembered`` words those not seen lately are encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode
        known: dict[bytes, bytes] = {}
        before: dict[bytes, bytes] = {}
        now = None

        def ids(word: bytes) -> bytes:
            nonlocal known, before
            found = known.get(word)
            if found is None:
                found = before.get(word)
                if found is None:
                    found = np.array(encode(word.decode()), dtype="<u4").tobytes()
                if len(known) >= remembered:
                    known, before = {}, known
                known[word] = found
            return found

        for batch in batches:
            packed = []
            for bucket, frame in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                if bucket != now:
                    known, before, now = {}, {}, bucket
                packed.append(_pack(list(map(ids, _unpack(frame.as_py())))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ranks"), pa.array(packed, pa.binary())], names=["block", "ranks", "coded"])

    return run


def _reassemble(path: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(blocks: pa.Table, coded: pa.Table) -> pa.Table:
        if blocks.num_rows != 1:
            raise RuntimeError("the documents were read differently the second time")
        bytes_of = coder(path).bytes_of.__getitem__
        of_word: dict[int, bytes] = {}
        for ranks, frame in zip(coded.column("ranks"), coded.column("coded"), strict=True):
            of_word.update(zip(_unpack_numbers(ranks.as_py()).tolist(), _unpack(frame.as_py()), strict=True))
        codes = _unpack_numbers(blocks.column("codes")[0].as_py())
        out: dict[str, list] = {name: [] for name in schema.names}
        at = 0
        for ident, length in zip(blocks.column("ids")[0], blocks.column("lengths")[0].as_py(), strict=True):
            packed = b"".join(map(of_word.__getitem__, codes[at : at + length].tolist()))
            at += length
            ids = np.frombuffer(packed, dtype="<u4")
            out["id"].append(ident.as_py())
            out["n_tokens"].append(len(ids))
            out["token_ids"].append(packed)
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(map(bytes_of, ids.tolist()))).hexdigest())
        return pa.table(out, schema=schema)

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, token_ids (little-endian unsigned 32-bit numbers), ids_sha256, decoded_sha256 of each row.

    ``docs`` is read twice and must come alike both times, as files do; a
    block that does not match fails. decoded_sha256 is that of the bytes that
    the ids decode to, which are the text's. A null or empty text has no
    tokens; a text of any length is encoded whole, in a block of its own if it
    is longer than one. Null ids and repeated rows are returned as they come; no rows give
    no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long"), text_col)
    buckets = shuffle_partitions(docs.sparkSession)
    sequences = texts.mapInArrow(_blocks(pattern, _sequences), "block string, ids array<long>, lengths array<int>, codes binary")
    words = texts.mapInArrow(_blocks(pattern, _words(buckets)), "block string, bucket int, ranks binary, words binary")
    dealt = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    coded = dealt.mapInArrow(_encode_buckets(path, REMEMBERED), "block string, ranks binary, coded binary")
    out = "id long, n_tokens long, token_ids binary, ids_sha256 string, decoded_sha256 string"
    return sequences.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_reassemble(path), out).withColumnRenamed("id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
