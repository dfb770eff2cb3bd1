"""Claims met in batches give the pairs that the joins give, whatever the size of blocks, and need no join."""

import random

import pytest

from tessera import catalog
from tessera.plans import matching

KINDS = "{} string, words array<string>, numbers array<string>"


@pytest.fixture(scope="module")
def rows(spark):
    some = random.Random(5)
    vocabulary = [f"w{n:02}" for n in range(40)]
    pick = lambda most: sorted(some.sample(vocabulary, some.randint(4, most)))
    figures = lambda: some.sample(["1", "2", "3"], some.choice([0, 0, 1, 2]))
    claims = spark.createDataFrame([(f"c{n}", pick(14), figures()[:1]) for n in range(60)], KINDS.format("claim_id"))
    sources = [(n, [(pick(9), figures()) for _ in range(some.choice([0, 1, 2, 3, 40]))]) for n in range(50)]
    return claims, spark.createDataFrame(sources, "source long, units array<struct<words array<string>, numbers array<string>>>").repartition(3)


@pytest.mark.parametrize("cells", [1, 60 * 2, 60 * 7, 2_000_000])
def test_batches_give_what_joins_give(rows, monkeypatch, cells):
    claims, units = rows
    joined = {tuple(r) for r in matching.fitting_pairs(claims, units, 0).collect()}
    monkeypatch.setattr(matching, "MAX_CELLS", cells)
    batched = [tuple(r) for r in matching.fitting_pairs(claims, units).collect()]
    assert set(batched) == joined and len(batched) == len(joined) > 100


def test_nothing_to_meet(rows):
    claims, units = rows
    assert matching.best_pairs(claims.limit(0), units).count() == matching.best_pairs(claims, units.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["v1_anchor", "v20_reanchor", "v1_provenance", "v20_provenance_gained"])
def test_one_search_without_joins(name, spark, sf_dir, monkeypatch):
    """Few claims shuffle neither texts nor candidates, and what they hold and gain comes of one search."""
    searches = []
    search = matching._windows_of
    monkeypatch.setattr(matching, "_windows_of", lambda claims: searches.append(1) or search(claims))
    monkeypatch.setattr(matching, "candidate_pairs", None)
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0 and len(searches) == 1


def test_sentences_read_in_batches_and_in_sql_are_the_same(spark, sf_dir):
    """What tasks read of a text to anchor claims are the rows that the expressions give, whose SQL the queries are checked against."""
    from pyspark.sql import functions as F

    from tessera.functions.units import plain_units
    from tessera.plans.anchor import by_rarity, ranked, source_sentences
    from tessera.sources.tables import table

    odd = [None, "", "  \x0bAlpha beta gamma DELTA.Next one two three four\n\n1,234.50 or 7,, and 3. of \x1cİstanbul Straße ﬁve six\x85seven K2 9.", "no. words! here? 12", "ÄÖÜ äöü abc def ghi jkl 5.5.5 1.,2"]
    texts = dict(enumerate(odd)) | {1000 + r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    common = ["beta", "three", "claim"] + [f"w{n}" for n in range(20)] + ["gamma"]
    want = {(r.source, r.position): (r.sentence, r.w, set(r.numbers)) for r in source_sentences(frame, "id", "text").withColumn("w", ranked(F.col("words"), common)).collect()}
    rank = by_rarity(common)
    assert {(k, n): (s, rank(w), m) for k, t in texts.items() for n, (s, _, w, m) in enumerate(plain_units(t or ""))} == want and len(want) > 100


def test_anchors_write_no_sentences(spark, sf_dir, monkeypatch):
    from tessera.plans import anchor

    monkeypatch.setattr(anchor, "written", None)
    assert catalog.QUERIES["v1_anchor"](spark, sf_dir).count() > 0
