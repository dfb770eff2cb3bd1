"""Phrase collocations against brute force and on odd rows."""

from collections import Counter

import brute
import numpy as np
import pytest

from oracle import assert_same, connect
from tessera.llm import catalog, phrases
from tessera.llm.shared import read


@pytest.mark.parametrize("setting", [{}, {"SHARD_BYTES": 20_000, "BATCH": 50, "HELD": 1000, "MAX_BROADCAST_ROWS": 0}])
def test_collocations_equal_plain_counts(spark, sf_dir, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(phrases, name, value)
    docs = read(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    got = phrases.collocations(docs, least=4, most=300).collect()
    want = brute.collocation_rows(rows, 4, 300)
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want


def test_collocations_equal_their_sql(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    assert_same(catalog.QUERIES["op12_collocations"](spark, folder), connect(folder), catalog.SQL["op12_collocations"])


def test_collocations_on_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("lang", "text").collect()]
    assert Counter(tuple(r) for r in phrases.collocations(odd, 2).collect()) == Counter(brute.collocation_rows(rows, 2, 2000))
    assert phrases.collocations(none).count() == 0


def test_pieces_overlaps_and_ties(spark):
    texts = ["a a a a a", "a a. a a", "new york city\nnew york,city", "New\tYork City", "b c b c b c", "c b;c b", "", None, "\x85x \x85x   y"]
    rows = [(None if n % 3 == 0 else "und" if n % 3 == 1 else "en", t) for n, t in enumerate(texts * 4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(docs, 2, 50).collect()} == brute.collocation_rows(rows, 2, 50)


def test_bitmaps_round_trip():
    some = np.random.default_rng(5)
    counts = some.integers(1, 50, 300)
    positions = np.concatenate([np.sort(some.choice(1 << some.integers(6, 30), n, replace=False)) for n in counts])
    assert (phrases.unpack_bitmaps(phrases.pack_bitmaps(positions, counts), counts) == positions).all()
    numbers = some.integers(0, 1 << some.integers(1, 62, 1000))
    assert (phrases.unpack_numbers(phrases.pack_numbers(numbers)) == numbers).all()


def test_full_slots_lose_nothing(spark, sf_dir):
    """With every slot set, as in a corpus that fills them, the exact counts decide alone."""
    docs = read(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    full = np.full(1 << phrases.MAP_BITS - 3, 255, dtype=np.uint8)
    kept = phrases._bitmap
    try:
        phrases._bitmap = lambda sums, least: full
        got = phrases.collocations(docs, least=6, most=200).collect()
    finally:
        phrases._bitmap = kept
    assert {tuple(r) for r in got} == brute.collocation_rows(rows, 6, 200)


def test_hashes_do_not_depend_on_the_place():
    words = ["the", "of", "x", "ünï", "thethe"]
    for order in (words, words[::-1]):
        found = dict(zip(order, phrases.word_hashes(" ".join(order).encode(), "en").tolist()))
        assert found == {w: phrases.word_hashes(w.encode(), "en")[0] for w in words}
    assert phrases.word_hashes(b"the", "en")[0] != phrases.word_hashes(b"the", "de")[0]


def test_scores_pass_64_bits(spark):
    big = 3 * 10**15
    sql = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(b as decimal(19, 0)) * cast(b as decimal(19, 0)))"
    row = spark.createDataFrame([(big, big // 7)], "a long, b long").selectExpr(f"{sql} AS s").first()
    assert row.s == 1000 * big * big // (big // 7) ** 2
