"""Readers pass on what they have read after a bounded piece of a batch, not after its ten thousand rows."""

import pyarrow as pa

from tessera.functions.units import PIECE_CHARS, UNITS, evidence_units, pieces, units_of
from tessera.sources import readers


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"n": list(range(7))})
    for most in (1, 3, 100):
        cut = list(pieces(batch, [0, 5, None, 1, 1, 1, 0], most))
        assert [n for piece in cut for n in piece.column(0).to_pylist()] == list(range(7))
    assert len(list(pieces(batch, [9] * 7, 1))) == 7 and len(list(pieces(batch.slice(0, 0), [], 1))) == 0


def test_units_leave_in_pieces():
    texts = ["flood water rises quickly 7. " * (PIECE_CHARS // 60)] * 6 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"key": list(range(8)), "text": pa.array(texts, pa.string())})
    out = list(units_of(evidence_units)(iter([batch])))
    assert len(out) >= 3 and [k for b in out for k in b.column(0).to_pylist()] == list(range(8))
    assert [len(u) for b in out for u in b.column(1).to_pylist()] == [PIECE_CHARS // 60] * 6 + [0, 0] and "words" in UNITS


def test_pages_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(readers, "PIECE_CHARS", 1)
    pages = {1: "<title>T</title><p>one <b>two</b></p>", 2: None, 3: "", 4: "plain"}
    got = readers.main_text(spark.createDataFrame(list(pages.items()), "id long, html string").coalesce(1), "id", "html").collect()
    assert {r.id: (r.title, r.text) for r in got} == {k: readers.page_text(h) for k, h in pages.items()}
