"""The pipeline's stages against plain versions of what each does to the rows before it."""

import re
from collections import Counter

import brute
import public_tokenizers as P

import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm.shared import read


def test_pipeline(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    rows = {r.doc_id: r.text for r in docs.where(quality.quality(model)["accepted"]).collect()}
    assert 0 < len(rows) < docs.count()

    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    rows = {i: rows[i] for i in first.values()}

    kept = {i for i, _, component in brute.simhash_rows(rows.items()) if i == component}
    rows = {i: rows[i] for i in kept}

    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    mixed = mixing.mix_sources(spark.createDataFrame([(i, t, sources[i]) for i, t in rows.items()], "doc_id long, text string, source string"))
    copies = {r.doc_id: r.copies for r in mixed.collect()}

    want = Counter()
    for row in brute.bpe_rows(rows.items(), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN):
        want[row] += copies[row[0]]
    got = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == +want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_on_no_rows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_on_odd_rows(spark, odd):
    """Null ids, repeated rows, empty and long texts and clashing columns pass through every stage."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (6, 0)], "doc_id long, quality int")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        after = stage(spark, docs, "").cache()
        assert after.columns == docs.columns, name
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in docs.collect()}, name
        docs = after
    texts = [r.text for r in docs.select("text").collect()]
    assert None in texts or "" in texts or " \n\t " in texts
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(texts)
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_stages_keep_one_of_equal_rows(spark, odd):
    exact = corpus_pipeline.exact_stage(spark, odd, "")
    assert exact.where("doc_id = 8").count() == 1  # of two equal rows of one id; its other text is another row's
    near = corpus_pipeline.near_stage(spark, odd.where("doc_id = 8 AND text LIKE 'The%'"), "")
    assert near.count() == 1
