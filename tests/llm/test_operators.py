"""The corpus operators against brute force and on odd rows."""

import re
from collections import Counter

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from odd_rows import TEXTS

from oracle import assert_same, connect
from tessera.llm import bpe, catalog, exact_dedup, line_templates, mixing, pii, quality, shared, simhash, token_files, url_filter, vector_dedup
from tessera.llm.components import connected_components
from tessera.llm.shared import checkpoint_dir, read

BPE, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(name, spark, sf_dir):
    assert_same(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir), catalog.SQL[name])


def test_same_columns_for_no_rows(spark, none, tmp_path):
    assert mixing.mix_sources(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.keep_first(none).count() == 0
    assert line_templates.recurring_lines(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert bpe.encode_documents(none, BPE, P.PATTERN).count() == 0
    assert simhash.near_dedup(none).count() == simhash.one_of_each_group(none).count() == 0
    assert mixing.mixed_rows(none).count() == 0
    shards, dictionary = token_files.write_token_files(none, JSON, f"file://{tmp_path}")
    assert token_files.read_token_files(spark, f"file://{tmp_path}", shards, dictionary).count() == 0
    urls = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(urls, url_filter.rules_frame(spark, url_filter.QUERY_RULES)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_vectors(vectors).count() == 0
    assert none.where(quality.quality(quality.train(none, spark.createDataFrame([], "doc_id long, quality int")))["accepted"]).count() == 0


# 1 mixing


def test_mixing_targets_and_sizes(spark, odd):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(TEXTS)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, words(t)) for i, t in TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size <= 2 * r.size
    for own in by.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert own[0].target <= 2 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(odd).collect()))


def test_mixing_ranges_do_not_change_the_result(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    whole = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect())) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_mixing_splits_sources_of_poor_quality(spark):
    """Texts without spaces have keys far apart from others'; their source still spans many partitions."""
    rows = [(n, "x" * 300 if n % 3 else "plain words of usual length here", "a") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert abs(sum(r.taken for r in got) - got[0].target) <= max(r.size for r in got) / 2


def test_mixed_rows_repeat(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect() if r.copies}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(copies)


# 2 exact dedup


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("least_hot", [16, 1])
def test_exact_dedup_on_odd_rows(odd, least_hot):
    rows = exact_dedup.exact_dedup(odd, least_hot=least_hot).collect()
    groups = _exact(TEXTS)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, least[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")], len(groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")])) for i, t in TEXTS)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({r.text_sha256: 1 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_keep_first_returns_whole_rows(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(_exact(TEXTS))
    assert {r.norm for r in kept.select("norm").collect()} == {"clash"}


# 3 quality


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), read(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", quality.quality(model)["accepted"].alias("a")).collect()
    right = [(r.quality == 1) == r.a for r in held]
    good = [r.a for r in held if r.quality == 1]
    assert sum(right) / len(right) >= 0.95
    assert sum(good) / len(good) >= 0.97


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (4, None), (None, 1), (6, 0), (6, 1), (7, 0)], "doc_id long, quality int")
    scored = odd.select("doc_id", quality.quality(quality.train(odd, labels)).alias("r")).collect()
    assert len(scored) == len(TEXTS)
    assert all(0 <= r.r.score <= 1 for r in scored)
    one_class = quality.train(odd, labels.where("quality = 1"))
    assert one_class is None
    assert quality.keep_good(odd, labels.where("quality = 1")).count() == len(TEXTS)


def test_quality_reruns_agree_and_read_every_source(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    models = [quality.train(d, labels) for d in (twice, twice.orderBy(F.desc("doc_id"), "text").coalesce(1))]
    assert all(np.array_equal(a, b) for a, b in zip(models[0].weights, models[1].weights))
    assert np.array_equal(models[0].combination, models[1].combination)
    model = quality.Model(*[[((np.array([n % 2]), np.ones(1)), (np.array([n % 2]), np.ones(1))) for n in range(40)], np.arange(40) % 2.0])
    gathered = quality._gathered(docs, "doc_id", labels.select(F.col("doc_id").alias("l_id")).limit(0), model)
    assert gathered.count() <= quality.SOURCE_GROUPS * 4 * quality.GATHERED


def _plain_quality(rows, labels):
    """Co-training written with dense rows and all documents held at once: weights, calibrations and combination."""
    from zlib import crc32

    q = quality
    order = sorted(rows, key=lambda i: (crc32(str(i).encode()), i))
    dense = {}
    for i, row in rows.items():
        pair = []
        for (slots, values), size in zip(q.views(*row), (q.TEXT_SIZE, q.META_SIZE)):
            x = np.zeros(size)
            np.add.at(x, slots, values)
            pair.append(x.astype(np.float32).astype(float) if size == q.TEXT_SIZE else x)
        dense[i] = pair
    known = [i for i in order if i in labels]
    y = np.array([float(labels[i] >= 0.5) for i in known])
    place = np.arange(len(y))
    first, second = place % 8 == 0, place % 8 == 4
    kept = ~(first | second)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(x, y, w):
        share = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
        m = v = np.zeros(x.shape[1])
        for t in range(1, q.STEPS + 1):
            g = x.T @ ((sigmoid(x @ w) - y) * share) + q.RIDGE * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return w

    all_rows = [np.array([dense[i][v] for i in known]) for v in (0, 1)]
    x, seen = [a[kept] for a in all_rows], [y[kept], y[kept]]
    w = [fit(x[v], seen[v], np.zeros(x[v].shape[1])) for v in (0, 1)]
    free = [i for i in order if i not in labels]
    for _ in range(q.ROUNDS):
        p = [sigmoid(np.array([dense[i][v] for i in free]) @ w[v]) for v in (0, 1)]
        gone, more = set(), [[], []]
        for v in (0, 1):
            for label, sure, other in ((1.0, p[v], p[1 - v]), (0.0, 1 - p[v], 1 - p[1 - v])):
                best = [j for j in np.argsort(-sure, kind="stable").tolist() if sure[j] >= q.CONFIDENT and other[j] >= q.DOUBT][: q.EXCHANGED]
                more[1 - v] += [(free[j], label) for j in best]
                gone |= {free[j] for j in best}
        if not gone:
            continue
        for v in (0, 1):
            if more[v]:
                x[v] = np.concatenate([x[v], [dense[i][v] for i, _ in more[v]]])
                seen[v] = np.concatenate([seen[v], [label for _, label in more[v]]])
        free = [i for i in free if i not in gone]
        w = [fit(x[v], seen[v], w[v]) for v in (0, 1)]
    return w, [a @ v for a, v in zip(all_rows, w)], y, (first, second)


def test_rounds_equal_plain_cotraining(spark, sf_dir, monkeypatch):
    """Every round chooses from all documents; with room for all of them a dense version chooses the same."""
    monkeypatch.setattr(quality, "GATHERED", 10_000)
    monkeypatch.setattr(quality, "EXCHANGED", 25)
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = read(spark, folder, "documents").where("doc_id < 500")
    labels = read(spark, folder, "labels")
    rows = {r.doc_id: (r.text, r.lang, r.source, float(r.n_chars)) for r in docs.collect()}
    own = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    model = quality.train(docs, labels.where("doc_id < 500"))
    weights, logits, y, parts = _plain_quality(rows, own)
    for v in (0, 1):
        assert np.allclose(model.weights[v], weights[v], atol=1e-6)
    seen, answers = [], []
    for fitted, shown in (parts, parts[::-1]):
        calibrated = []
        for x in logits:
            a, b = quality._platt(x[fitted][:, None], y[fitted])
            calibrated.append(np.clip(a * x[shown] + b, -12, 12))
        seen.append(np.column_stack(calibrated))
        answers.append(y[shown])
    x, answers = np.concatenate(seen), np.concatenate(answers)

    def loss(w):
        """What the combination keeps small, a weight below zero forbidden."""
        return np.logaddexp(0, (1 - 2 * answers) * (x @ w[:2] + w[2])).sum() + ((w[:2] - 0.5) ** 2).sum() / 2 + w[2] ** 2 / 2

    assert (model.combination[:2] >= 0).all()
    rng = np.random.default_rng(2)
    for step in rng.normal(size=(300, 3)) * 0.05:
        other = model.combination + step
        other[:2] = np.where(model.combination[:2] == 0, 0, other[:2])
        assert loss(other) >= loss(model.combination) - 1e-9 or (other[:2] < 0).any()


# 4 line templates


def test_recurring_templates_go(spark, odd):
    rows = [(i, f"{'abcdefghij'[i]} line of its own\nUser {i} logged in at {i}:00 from host{i}\nfooter\n\n") for i in range(8)]
    cleaned = {r.doc_id: r for r in line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.text == f"{'abcdefghij'[i]} line of its own\n\n" and r.n_dropped == 2 and r.n_lines == 5 for i, r in cleaned.items())


def test_templates_need_documents(spark):
    rows = [(1, "same line\n" * 50)] + [(i, f"same line\nother {i}") for i in (2, 3)]
    got = line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == 0


def test_long_lines_recur_in_two_texts(spark):
    long, short = " ".join(f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(51)), "just a short line here"
    numbers = "1 22 333\t4444  55555"
    rows = [(1, f"one\n{long}\n{short}"), (2, f"{long}\ntwo\n{short}"), (3, f"three\n{long} more"), (4, f"three\n{long} more")]
    rows += [(10 + i, f"{numbers}\n{i} 22 333 4444 {i}\nown{'abcdefg'[i]} tail") for i in range(5)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (f"one\n{short}", 1) and got[2] == (f"two\n{short}", 1)
    assert got[3] == (f"three\n{long} more", 0)  # copies are one text
    assert all(got[10 + i] == (f"{i} 22 333 4444 {i}\nown{'abcdefg'[i]} tail", 1) for i in range(5))


@pytest.mark.parametrize("setting", [{"LEAST_HOT": 0}, {"LEAST_HOT": 0, "MAX_BROADCAST_ROWS": 0}])
def test_hot_leaves_and_lines_change_nothing(spark, sf_dir, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(line_templates, name, value)
    assert_same(catalog.QUERIES["op4_line_templates"](spark, sf_dir), connect(sf_dir), catalog.SQL["op4_line_templates"])


def test_line_templates_on_odd_rows(odd):
    got = line_templates.recurring_lines(odd, min_docs=2).collect()
    assert len(got) == len(TEXTS)
    whole = Counter((i, t or "") for i, t in TEXTS)
    # Rows 1 and 8 share a line; of the repeated row 8 each loses it.
    lost = [r for r in got if r.n_dropped]
    assert {r.doc_id for r in lost} >= {1, 8}
    assert all(whole[(r.doc_id, r.text)] for r in got if not r.n_dropped)


# 5 personal data


HARD = [
    "a@b.c.@x.y a@b@c.de ..@-.- a_b%c+d@e-f.g-h.i9 @a.b a@b",
    "1.2.3 1.2.3.4.5 01.002.0003.255 1.1.1.256 .1.2.3.4. 1..2.3.4",
    "4111-1111-1111-1111 4111 1111 1111 1111 2 4111  1111 1111 1111 0000000000000000 6011000990139424 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (743) 555-3824 +12 345 67 ++4912345678 +1-2-3-4-5-6-7-8. +1 2345678901234567 +123456789.",
    "😀 a@b.co 😀 10.1.2.3 ß +49 30 1234567",
]


def test_personal_data_equals_the_plain_patterns(spark, odd):
    rows = [*TEXTS, *((100 + n, t) for n, t in enumerate(HARD))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find_personal_data(docs).collect()
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in got) == Counter((i, tuple(brute.base_spans(t))) for i, t in rows)


def test_personal_data_whole_query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = catalog.QUERIES["op5_pii"](spark, sf_dir).collect()
    assert {tuple(r)[:6] for r in got} == {brute.base_row(*d) for d in docs}
    assert all(r.has_personal_data == bool(r.spans) and r.n_added == r.spans.count(":") // 2 - sum(r[1:5]) for r in got)


def test_added_spans_equal_plain_ones(spark, sf_dir, monkeypatch):
    """The added spans of all documents, from plain patterns, votes and the same estimate."""
    rows = [(i, t or "") for i, t in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [(-1 - n, f"password: {'0123456789abcdef' * 2}{n:x} of Dr. Maria Smith, SSN 123-45-678{n}, (415) 555-000{n} x") for n in range(8)]
    kept = {}
    fit = pii.fit_classifier
    monkeypatch.setattr(pii, "fit_classifier", lambda r, c: kept.setdefault("w", fit(r, c)))
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.added} for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(map(len, got.values())) >= 16
    for i, text in rows:
        base = brute.base_spans(text)
        want = set()
        for kind, (pattern, _) in pii.EXTRA.items():
            end = 0
            for m in regex.finditer(pattern, text):
                votes = brute.votes(kind, m[0], text[end : m.start()][-pii.CONTEXT :], pii)
                end = m.end()
                mix = 0 if not re.search("[0-9]", m[0]) else 2 if regex.search(r"\p{L}", m[0]) else 1
                w = kept["w"]
                score = w["always"] + sum(w[n] * v for n, v in votes.items()) + sum(w.get(k, 0.0) for k in (f"kind {kind}", f"length {min(len(m[0]) // 8, 4)}", f"mix {mix}"))
                support = sum(max(0, votes[n]) for n in ("shape", "gazetteer", "context"))
                if support >= 2 and score >= np.log(4) and not any(a < m.end() and m.start() < b for _, a, b in base):
                    want.add((kind, m.start(), m.end()))
        assert got[i] == want, i


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{n}@h{n % 7}.org" for n in range(30_000))
    row = pii.find_personal_data(spark.createDataFrame([(1, text), (2, "x@y.de")], "doc_id long, text string")).where("doc_id = 1").first()
    assert [(s.kind, s.start, s.end) for s in row.base] == brute.base_spans(text)


def test_added_spans_need_agreement(spark):
    rows = [(i, f"Customer name: Dr. Maria Smith, phone (415) 555-{1000 + i}, mail x{i}@y.com") for i in range(40)]
    rows += [(100 + i, f"see version 415 555-{1000 + i} of Dr. No") for i in range(40)]
    found = {r.doc_id: {s.kind for s in r.added} for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == {"person", "phone_local"} for i in range(40))
    assert not any(found[100 + i] for i in range(40))


def test_reliabilities_follow_agreement():
    rows = [{"kind": "a", "shape": 1, "gazetteer": 1, "context": 1, "against": 0, "length": 1, "n": 90}, {"kind": "a", "shape": -1, "gazetteer": -1, "context": 0, "against": -1, "length": 1, "n": 90}]
    right, chance = pii.reliabilities(rows)
    assert chance[0] > 0.9 > 0.1 > chance[1]
    assert min(right[:2]) > 0.9


def test_long_secrets_and_addresses(spark):
    """No length of a run hides what is in it."""
    long = "a" * 500 + "7" + "b" * 20
    texts = [f"token {long} end", f"mail {'x' * 90}[at]{'y' * 80}[dot]{'z' * 70}[dot]a[dot]b[dot]c[dot]d[dot]e[dot]com", "=" + "q" * 100_000, "1" * 100_000 + "[at" * 1000]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.array(*[F.regexp_extract("t", pii.EXTRA[k][0], 0) for k in ("secret", "email_hidden")]).alias("m")).collect()]
    assert got[0][0] == long and got[1][1] == texts[1][5:] and got[2] == got[3] == ["", ""]


# 6 URLs


def test_urls_on_odd_rows(spark):
    urls = [(1, None), (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.COM/en/x?q"), (6, "x://example.com/en"), (7, "http://sub.www.example.com/en/#f"), (8, "http://net/es/"), (9, "http://a.net?/es/"), (10, "http://" + "a." * 2000 + "net/fr/"), (11, "http://xnet/es/")]
    rules = url_filter.rules_frame(spark, url_filter.QUERY_RULES)
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect())
    want = [(1, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "example.com/en/", "block"), (6, "com/", "allow"), (7, "www.example.com/en/", "allow"), (8, "net/es/", "block"), (9, None, "allow"), (10, "net/fr/", "block"), (11, None, "allow")]
    assert got == Counter(want)


def test_urls_with_clashing_columns(spark):
    names = "host path rule verdict expression digest prefix labels rule_host rule_path best".split()
    rows = [(n, f"http://a{n}.example.com/en/" if n % 2 else "http://net/es/", *["clash"] * len(names)) for n in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, " + ", ".join(f"{c} string" for c in names))
    got = url_filter.judge_urls(frame, url_filter.rules_frame(spark, url_filter.QUERY_RULES)).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {
        (n, f"a{n}.example.com", "/en/", "example.com/en/", "block") if n % 2 else (n, "net", "/es/", "net/es/", "block") for n in range(6)
    }


# 7 BPE


def test_bpe(spark, odd, sf_dir, monkeypatch):
    assert Counter(r[:1] + r[1:2] + r[3:] for r in map(tuple, bpe.encode_documents(odd, BPE, P.PATTERN).collect())) == Counter(
        {(i, n, a, b): c for (i, n, a, b), c in Counter(x for t in TEXTS for x in brute.bpe_rows([t], BPE, P.PATTERN)).items()}
    )
    docs = read(spark, sf_dir, "documents")
    want = brute.bpe_rows([tuple(r) for r in docs.select("doc_id", "text").collect()], BPE, P.PATTERN)
    assert {tuple(r) for r in catalog.QUERIES["op7_bpe"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("remembered", [1_000_000, 3])
def test_bpe_does_not_depend_on_buckets_or_memory(spark, sf_dir, monkeypatch, remembered):
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    docs = read(spark, sf_dir, "documents").where("doc_id < 60")
    want = brute.bpe_rows([tuple(r) for r in docs.select("doc_id", "text").collect()], BPE, P.PATTERN)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13" if remembered == 3 else "2")
        assert {tuple(r) for r in bpe.encode_documents(docs, BPE, P.PATTERN).drop("token_ids").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_bpe_round_trip(odd):
    coder = bpe.coder(BPE)
    for r in bpe.encode_documents(odd.where("doc_id = 9"), BPE, P.PATTERN).collect():
        assert coder.decode(np.frombuffer(r.token_ids, "<u4").tolist()).decode() == dict(TEXTS)[9]


# 8 vectors


def test_vectors(spark, sf_dir):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = []
    for n in range(900):
        v = centres[n % 6] + rng.normal(size=16) * (0.12 if n % 3 else 0.5)
        rows.append((n, v.tolist(), n % 2 if n % 11 else None))
    rows += [(1000 + n, rows[5][1], 1) for n in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, [float("inf")] * 16, 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want, links = brute.vector_rows(rows)
    got = {tuple(r) for r in got.collect()}
    assert len(links) > 1000
    assert sum(r[1] for r in got) >= 0.9 * 2 * len(links)
    assert {(r[0], r[1] > 0) for r in got} == {(r[0], r[1] > 0) for r in want}
    assert all(r[1] <= dict((w[0], w[1]) for w in want)[r[0]] for r in got)
    assert got == want  # here the probes reach every cell


def test_vectors_whole_query(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert {tuple(r) for r in catalog.QUERIES["op8_vectors"](spark, sf_dir).collect()} == brute.vector_rows(rows)[0]


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(n, (np.ones(8) + rng.normal(size=8) * 0.1 * (n % 4)).tolist(), 0) for n in range(200)]
    got = {tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute.vector_rows(rows)[0]


def test_vectors_with_many_lists_in_reach(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "LIST_SIZE", 3)
    rng = np.random.default_rng(11)
    units = np.ones(16) + rng.normal(size=(900, 16)) * 0.27
    index = vector_dedup.Index(units / np.linalg.norm(units, axis=1, keepdims=True), 300)
    reach = (2 - 2 * vector_dedup.LEAST_COSINE) ** 0.5
    probes = index.place(units / np.linalg.norm(units, axis=1, keepdims=True), reach)[1]
    assert len(index.centroids) == 300 and np.median([len(p) for p in probes]) > 48
    rows = [(n, v.tolist(), 0) for n, v in enumerate(units)]
    got = {tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want, links = brute.vector_rows(rows)
    assert len(links) > 1000
    assert got == want


def test_vectors_with_null_ids_and_repeats(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    got = Counter(tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter({(1, 1, 1, True): 2, (None, 0, None, True): 1, (2, 0, 2, True): 1})


def test_vectors_of_odd_lengths_lose_no_links(spark):
    """Vectors whose squares vanish or overflow neither lose their own links nor those of others."""
    rng = np.random.default_rng(7)
    plain = [(n, (np.ones(8) + rng.normal(size=8) * 0.1).tolist(), 0) for n in range(60)]
    odd = [(100, [1e-200] * 8, 0), (101, [1e200] * 8, 0), (102, [5e-324] * 8, 0), (103, [1e308] * 8, 0)]
    same = [(n, [1.0] * 8 if n >= 100 else v, label) for n, v, label in plain + odd]
    schema = "vec_id long, embedding array<double>, label int"
    got = {tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame(plain + odd, schema)).collect()}
    assert got == brute.vector_rows(same)[0]


def test_vectors_with_clashing_columns_and_ties(spark):
    rows = [(n, [1.0, float(n % 2)] * 40, n % 3) for n in range(40)]
    names = "id class size embedding_ of links node component dims block"
    schema = "vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in names.split())
    got = {tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame([(*r, *["x"] * len(names.split())) for r in rows], schema)).collect()}
    assert got == brute.vector_rows(rows)[0]


def test_skewed_labels_get_lists_by_the_largest(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "LIST_SIZE", 20)
    rng = np.random.default_rng(13)
    rows = [(n, (np.ones(8) + rng.normal(size=8) * 0.4).tolist(), 0 if n % 20 else n) for n in range(600)]
    assert {tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()} == brute.vector_rows(rows)[0]


# 9 SimHash


def test_simhash(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in catalog.QUERIES["op9_simhash"](spark, sf_dir).collect()} == brute.simhash_rows(rows)


def test_hot_fingerprints_and_components(spark, monkeypatch):
    """A third of the rows is empty, another third one text; a component has very many fingerprints."""
    monkeypatch.setattr(shared, "LEAST_HOT", 3)
    words = [f"w{n}" for n in range(60)]
    rows = [(n, None if n % 3 == 0 else "the same text here again" if n % 3 == 1 else " ".join(words[: 40 + n % 5] + [str(n % 11)])) for n in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_dedup(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert len(got) == 600 and {tuple(r) for r in got} == brute.simhash_rows(rows)


@pytest.mark.parametrize("block", [2048, 8])
def test_fingerprint_links(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    fps = set(rng.integers(0, 1 << 63, size=40, dtype=np.uint64).tolist())
    for f in sorted(fps)[:4]:
        for _ in range(40):
            g = f
            for b in rng.choice(64, size=rng.integers(1, 6), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
    found = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in links]
    assert len(found) > 100
    assert brute.components(fps, found) == brute.components(fps, brute.near_fingerprints(fps))


def test_simhash_on_odd_rows(odd):
    got = simhash.near_dedup(odd).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((i, brute.fingerprint(t)) for i, t in TEXTS)
    by = {}
    for i, t in TEXTS:
        by.setdefault(brute.fingerprint(t), []).append(i)
    label = brute.components(set(by), brute.near_fingerprints(set(by)))
    least = {}
    for f, ids in by.items():
        least[label[f]] = min([i for i in ids if i is not None] + ([least[label[f]]] if least.get(label[f]) is not None else []), default=None)
    assert all(r.component_id == least[label[r.fp & (1 << 64) - 1]] for r in got)
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter([*{v for v in least.values() if v is not None}, None, None])


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute.components(set(range(51)) | set(range(100, 160)), [p for p in links if None not in p])


# 10 token files


def test_token_files(spark, odd, sf_dir, tmp_path, monkeypatch):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in catalog.QUERIES["op10_token_files"](spark, sf_dir).collect()} == brute.token_rows(rows, JSON)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 500)
    shards, dictionary = token_files.write_token_files(odd, JSON, f"file://{tmp_path}")
    got = token_files.read_token_files(spark, f"file://{tmp_path}", shards, dictionary).collect()
    assert len(got) == len(TEXTS)
    want = Counter((i, n, c) for t in TEXTS for i, _, n, c in brute.token_rows([t], JSON))
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == want
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order[:-1])]).tolist()
    assert [r.id for r in in_order] == sorted([r.id for r in in_order], key=lambda i: (i is not None, i))


def test_token_file_refuses_another_dictionary(spark, odd, tmp_path):
    token_files.write_token_files(odd, JSON, f"file://{tmp_path}")
    shard = next(tmp_path.glob("*.tok")).read_bytes()
    with pytest.raises(ValueError):
        list(token_files.read_shard(shard, b"another"))


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = ["", " ", "  a", "a  b", "a \n b\n\n c", "x\t y", "\n", " \n", "a\n", "\u00a0b c\u00a0", "a\u3000b  ", "don't it's  'll", "<|endoftext|> a <|endoftext|>b", "é" * 200 + " b", "a\r\nb \r\n c", "1 2 3\n4 5", "\nab cd\nef\n", "a \u180eb c\x1cd \x85 e", "x <|endoftext|>y z<|endoftext|> w", "\u0120a b\u0120", *(t or "" for _, t in TEXTS)]
    enc = token_files.WordEncoder(JSON)
    for _ in range(2):
        assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(pa.array(texts, pa.large_string()))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_checkpoint_dir_is_the_sessions(spark):
    assert spark.conf.get("spark.checkpoint.dir") in checkpoint_dir(spark)


def test_targets_share_the_excess_until_none_is_above(spark):
    rng = np.random.default_rng(0)
    for _ in range(4):
        sizes = (rng.pareto(0.8, size=int(rng.integers(1, 25))) * 100).astype(int)
        weights = np.array([(3, 1, 2)[i % 3] for i in range(len(sizes))], dtype=float)
        want, rest, free = np.zeros(len(sizes)), 1.5 * sizes.sum(), np.ones(len(sizes), dtype=bool)
        while rest > 1e-9 and free.any():
            want[free] += rest * weights[free] / weights[free].sum()
            rest = np.maximum(want - 2 * sizes, 0).sum()
            want = np.minimum(want, 2 * sizes)
            free = want < 2 * sizes - 1e-9
        frame = spark.createDataFrame([(f"s{i:02d}", int(s)) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.source_targets(frame, (3, 1, 2), 1.5, 2.0).orderBy("source").collect()]
        assert got == pytest.approx(want.tolist())
