"""Token counts of texts under a sentencepiece BPE model.

Such a model writes a space as U+2581 and puts one before the text. The
vocabulary is read once by each worker, and two things are proved of it before
any text is counted:

* no token holds U+2581 behind another character, so no merge passes from a
  word to the space behind it: a text may be cut there, and its count is the
  sum of its pre-tokens' counts;
* which tokens that begin with U+2581 are what the library gives for their own
  string: a pre-token among these counts one and is never merged.

Texts are cut, and pre-tokens told apart and added up, as arrays. Only distinct
pre-tokens outside that table reach the library, each about once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read

#: What the library writes for a space.
SPACE = "▁"
#: Texts are cut together up to about so many bytes, and words merged together up to so many characters.
BYTES_AT_ONCE = 8 << 20
CHARS_AT_ONCE = 100_000
#: Merged words whose counts a worker remembers: so many of the latest, and as many of those before them.
REMEMBERED = 500_000
REMEMBERED_CHARS = 64


class TokenCounter:
    """Counts the tokens of texts by a sentencepiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        if self.model.encode("a") != [self.model.piece_to_id(SPACE + "a")]:
            raise ValueError(f"{path} does not write a space before the text")
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError(f"{path} has tokens that reach over a space; texts cannot be cut there")
        self.begins = np.array([piece.startswith(SPACE) for piece in pieces])
        #: Words that, with a space before them, are one token.
        self.single = pa.array(self._proved(pieces), pa.large_string())
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def _proved(self, pieces: list[str]) -> list[str]:
        words = [(n, piece[1:]) for n, piece in enumerate(pieces) if piece.startswith(SPACE) and piece.strip(SPACE) == piece[1:] != ""]
        alone = self.model.encode([word for _, word in words], num_threads=1)
        return [word for (n, word), ids in zip(words, alone, strict=True) if ids == [n]]

    def _merged(self, words: list[str]) -> list[int]:
        """The count of each word with one space before it; joined words are told apart by the tokens that begin with a space."""
        counts: list[int] = []
        start = chars = 0
        for stop, word in enumerate(words, 1):
            chars += len(word) + 1
            if chars >= CHARS_AT_ONCE or stop == len(words):
                ids = np.array(self.model.encode(" ".join(words[start:stop]), num_threads=1))
                found = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
                if len(found) != stop - start:
                    raise RuntimeError("a word did not begin with its own space")
                counts += found
                start, chars = stop, 0
        return counts

    def _counts(self, words: pa.Array) -> np.ndarray:
        """The count of each distinct, not empty word with one space before it."""
        counts = np.ones(len(words), dtype=np.int64)
        rest = np.flatnonzero(np.asarray(pc.is_null(pc.index_in(words, self.single))))
        texts = words.take(pa.array(rest)).to_pylist()
        found = list(map(self.known.get, texts))
        missing = [i for i, n in enumerate(found) if n is None]
        for i in missing:
            found[i] = self.before.get(texts[i])
        new = [i for i in missing if found[i] is None]
        for i, n in zip(new, self._merged([texts[i] for i in new]), strict=True):
            found[i] = n
        if len(self.known) >= REMEMBERED:
            self.known, self.before = {}, self.known
        self.known.update((texts[i], found[i]) for i in missing if len(texts[i]) <= REMEMBERED_CHARS)
        counts[rest] = found
        return counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text of a large string array without nulls."""
        pieces = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        starts = np.asarray(pieces.offsets)
        flat = pieces.flatten()
        told = flat.dictionary_encode()
        codes = np.asarray(told.indices)
        filled = np.asarray(pc.binary_length(told.dictionary)) > 0
        table = np.zeros(len(filled), dtype=np.int64)
        table[filled] = self._counts(told.dictionary.filter(pa.array(filled)))
        counts = table[codes]
        self._add_runs(counts, codes, filled, told.dictionary, starts)
        total = np.append(0, np.cumsum(counts))
        found = total[starts[1:]] - total[starts[:-1]]
        # An empty text gets no space before it.
        found[np.asarray(pc.binary_length(texts)) == 0] = 0
        return found

    def _add_runs(self, counts: np.ndarray, codes: np.ndarray, filled: np.ndarray, words: pa.Array, starts: np.ndarray) -> None:
        """Counts words behind several spaces, and spaces at a text's end, by themselves: spaces merge with each other too.

        An empty piece stands for each space that another space or the end
        follows, and the space before the text counts as one.
        """
        empty = np.flatnonzero(~filled[codes])
        if not len(empty):
            return
        # Runs of empty pieces within a text, and the piece behind each run.
        first = np.zeros(len(codes) + 1, dtype=bool)
        first[starts] = True
        opens = np.append(True, (np.diff(empty) != 1) | first[empty[1:]])
        heads = np.flatnonzero(opens)
        sizes = np.diff(np.append(heads, len(empty)))
        behind = empty[heads] + sizes
        ends = first[behind]
        kinds = np.where(ends, -1, codes[np.minimum(behind, len(codes) - 1)]).astype(np.int64)
        keys, which = np.unique(np.stack([sizes, kinds]), axis=1, return_inverse=True)
        units = [" " * (size if kind >= 0 else size - 1) + (words[kind].as_py() if kind >= 0 else "") for size, kind in keys.T.tolist()]
        # The library puts the first space itself; one space alone is one token, for which it gives none.
        found = np.array([len(ids) for ids in self.model.encode(units, num_threads=1)], dtype=np.int64)
        found[np.array([unit == "" for unit in units])] = 1
        counts[empty[heads]] = found[which.reshape(-1)]
        counts[behind[~ends]] = 0


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter of that file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def _groups(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in groups of about ``BYTES_AT_ONCE``, each with its place."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def _count_docs(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for start, group in _groups(texts):
                ids = batch.column(0).slice(start, len(group))
                sizes = pc.binary_length(group).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(count(group), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each row.

    ``path`` is a sentencepiece BPE model that leaves texts as they are,
    begins them with a space and cuts words at spaces; one whose tokens reach
    over a space is an error. No begin or end tokens are counted, and the
    strings of special tokens inside a text are ordinary text.

    A null or empty text has no tokens; a text of any length is counted whole,
    by one task, which holds about ``BYTES_AT_ONCE`` of texts or one longer
    text. Null ids, repeated ids and repeated rows are returned as they come;
    no rows give no rows; other columns are ignored, whatever their names.
    Documents are neither shuffled nor sorted, so there are no hot keys.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_count_docs(path), "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
