"""Runs of characters that two texts share, found by sampled hashes of short pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.units import PIECE_CHARS, pieces

#: The shortest run that counts, and the pieces whose hashes are sampled.
RUN = 40
PIECE = 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)


def piece_hashes(text: str, size: int) -> np.ndarray:
    """A hash of each piece of ``size`` characters, in order; equal pieces have equal hashes wherever they stand."""
    codes = _codes(text)
    if len(codes) < size:
        return np.zeros(0, dtype=np.uint64)
    powers = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(codes * powers))
    hashes = (sums[size:] - sums[:-size]) * np.cumprod(np.full(len(codes) - size + 1, _BACK, dtype=np.uint64))
    hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ hashes >> np.uint64(32)


def _window_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least value of each window of ``size``: minima of doubling windows, two of which cover it."""
    reach = 1
    while 2 * reach <= size:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def sampled(text: str, run: int = RUN, piece: int = PIECE) -> np.ndarray:
    """Distinct hashes of pieces, so chosen that two texts which share ``run`` characters share one.

    Winnowing (Schleimer et al., 2003): the least hash of every window of
    ``run - piece + 1`` pieces, whichever text the window stands in.
    """
    hashes = piece_hashes(text, piece)
    window = run - piece + 1
    return np.unique(_window_min(hashes, window)) if len(hashes) >= window else np.zeros(0, dtype=np.uint64)


def sample_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: rows (key, text) as rows (key, mark), a mark for each sampled hash."""
    for batch in batches:
        found = [sampled(t.as_py() or "") for t in batch.column(1)]
        places = np.repeat(np.arange(len(found)), [len(f) for f in found])
        marks = np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(marks)], names=["key", "mark"])


def _shares(draft: str, other: str, size: int) -> tuple[int, int] | None:
    """Where the other text's first piece of ``size`` characters stands that the draft has too, in the other and in the draft."""
    theirs, own = piece_hashes(other, size), piece_hashes(draft, size)
    for place in np.flatnonzero(np.isin(theirs, own)).tolist():
        # Equal hashes are told from equal texts.
        at = draft.find(other[place : place + size])
        if at >= 0:
            return place, at
    return None


def shared_run(draft: str, other: str, run: int = RUN) -> tuple[int, int, int] | None:
    """The first place of the other text where ``run`` characters of the draft begin, and the length and place of the longest shared run.

    If a run of some length is shared, so is one of each lesser length, so the
    length is found by halving; each step is linear in the texts.
    """
    first = _shares(draft, other, run)
    if first is None:
        return None
    least, most, place = run, min(len(draft), len(other)), first[0]
    while least < most:
        middle = (least + most + 1) // 2
        found = _shares(draft, other, middle)
        if found is None:
            most = middle - 1
        else:
            least, place = middle, found[0]
    return first[0], least, place


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: rows (key, other, draft, text) that share a run, with first, length and place."""
    for batch in batches:
        found = [shared_run(d.as_py(), t.as_py()) for d, t in zip(batch.column(2), batch.column(3), strict=True)]
        kept = pa.array([n for n, f in enumerate(found) if f is not None], pa.int64())
        columns = [pa.array([f[k] for f in found if f is not None], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), *columns], names=["key", "other", "first", "length", "place"])


def runs_with(drafts: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows (other, text) as rows (key, other, window, length, run), one for each of the drafts (key, text) that shares a run.

    White space of the texts is collapsed as they are read; a text is sampled
    once and compared with the drafts that have a mark of it.
    """
    own = drafts.column(1).to_pylist()
    samples = [sampled(d) for d in own]
    marks = np.concatenate([*samples, np.zeros(0, dtype=np.uint64)])
    order = np.argsort(marks, kind="stable")
    holders = np.repeat(np.arange(len(own)), [len(s) for s in samples])[order]
    marks = marks[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, pc.utf8_length(whole.column(1)).to_pylist(), PIECE_CHARS)):
            found = []
            for row, text in enumerate(batch.column(1)):
                other = " ".join((text.as_py() or "").split())
                theirs = sampled(other)
                first, last = np.searchsorted(marks, theirs), np.searchsorted(marks, theirs, side="right")
                for draft in sorted({holders[n] for a, b in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True) for n in range(a, b)}):
                    if shared := shared_run(own[draft], other):
                        start, length, place = shared
                        found.append((draft, row, other[start : start + RUN], length, other[place : place + length]))
            draft, row, window, length, longest = zip(*found, strict=True) if found else ([],) * 5
            columns = [drafts.column(0).combine_chunks().take(pa.array(draft, pa.int64())), batch.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(window, pa.string()), pa.array(length, pa.int64()), pa.array(longest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "other", "window", "length", "run"])

    return run
