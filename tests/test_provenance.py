"""Provenance of claims against plain loops over all windows, and the readers of units on odd texts."""

import random
import re

import pytest

from tessera import catalog
from tessera.functions.text import STOPWORDS
from tessera.functions.units import content_tokens, evidence_units, quantities
from tessera.plans import provenance as P
from tessera.sources.tables import table

# The rules written plainly: each number looks back over the whole text before it, and each run is read anew.


def plain_tokens(text):
    def money(m):
        amount = float(m[1].replace(",", ""))
        return f" money{int(amount) if amount == int(amount) else amount} "

    text = re.sub(r"\$\s*(\d[\d,]*(?:\.\d+)?)", money, text)
    text = re.sub(r"(?i)(?<![\w.])(\d[\d,]*(?:\.\d+)?)\s*(?:%|percent\b|per\s+cent\b)", lambda m: f" pct{m[1].replace(',', '')} ", text)
    return {w for w in re.sub(r"[^\w\s]", " ", text.lower()).split() if len(w) > 2 and w not in STOPWORDS}


KEYWORDS = r"(?i)(?:\b(?:Sections?|Articles?|Clauses?|Exhibits?|Appendix|Appendices|Schedules?|Paragraphs?|Pages?|Nos?)\.?|§)"


def plain_quantities(text):
    out = set()
    for m in re.finditer(r"\d+(?:,\d+)*(?:\.\d+)?", text):
        if any(i.start() <= m.start() and m.end() <= i.end() for i in re.finditer(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+){2,}", text)):
            continue
        line = text[: m.start()].rfind("\n") + 1
        if re.fullmatch(r"[ \t]*", text[line : m.start()]) and re.match(r"[.)][ \t\n]", text[m.end() :]) and m[0].isdigit():
            continue
        keywords = list(re.finditer(KEYWORDS, text[: m.start()]))
        between = text[keywords[-1].end() : m.start()] if keywords else "x"
        if re.fullmatch(r"(?i)[ \t]*(?:(?:\d+(?:,\d+)*(?:\.\d+)?|and|or|to|through|thru|&|,|;|–|—|-)[ \t]*)*", between):
            continue
        out.add(f"{float(m[0].replace(',', '')):.6f}".rstrip("0").rstrip("."))
    return out


def plain_units(text):
    found, page = [], None
    for n, piece in enumerate(re.split(r"--- Page (\d+) ---", text or "")):
        if n % 2:
            page = int(piece)
        else:
            found += [(s.strip(), page) for s in re.split(r"[.!?\n]+", piece) if s.strip()]
    merged, run = [], []
    for part in found:
        run.append(part)
        if len(plain_tokens(" ".join(s for s, _ in run))) >= 4:
            merged.append(run)
            run = []
    out = []
    for run in merged + [run] * bool(run):
        joined = " ".join(s for s, _ in run)
        if len(plain_tokens(joined)) >= 4:
            out.append((joined, next((p for _, p in run if p is not None), None), plain_tokens(joined), plain_quantities(joined)))
    return out


def plain_provenance(claims, sources, held=()):
    """claims {id: text} and sources {id: text}: every claim against every window."""
    units = {key: plain_units(text) for key, text in sorted(sources.items())}
    windows = [(key, a, own[a:b], set().union(*(u[2] for u in own[a:b])), set().union(*(u[3] for u in own[a:b]))) for key, own in units.items() for a in range(len(own)) for b in range(a + 1, min(a + 3, len(own)) + 1)]
    out = {}
    for claim, text in claims.items():
        words, numbers = plain_tokens(text.strip()), plain_quantities(text.strip())
        best = None
        for key, start, own, tokens, figures in windows:
            shared = len(words & tokens)
            if len(words) < 4 or shared < 4 or numbers - figures or shared / min(len(words), len(tokens)) < 0.6:
                continue
            rank = (-shared / min(len(words), len(tokens)), len(own), key, start)
            if best is None or rank < best[0]:
                best = (rank, own)
        if best is None or (claim, best[0][2]) in held:
            continue
        (score, width, key, start), own = best
        fits = [(len(words & u[2]) / min(len(words), len(u[2])), -i, u[0]) for i, u in enumerate(own) if len(words & u[2]) >= 4]
        window = " ".join(u[0] for u in own)
        quote = (max(fits)[2] if fits else window)[:280].strip()
        out[claim] = (claim, key, own[0][1], quote, window, f"{start}-{start + width - 1}", round(-score, 6))
    return out


PARTS = [
    "Section", "Sections", "no.", "Nothing", "§", "Appendices", "page", "Pages", "5", "6", "1,000", "$", "2.50", "%", "percent", "per", "cent", "and", "to", ",", ";", "–", "-", "A-1-2024", "2026-001-07",
    "7. ", "8) ", "\n", "\n  3. ", "\t", "the", "deductible", "limit", "Flood", "insured premises", "ab", "--- Page 4 ---", "--- Page 12 ---", ".", "!", "? ", " ", "  ", "x5", "5x", "toNo", "Ünï", "٣",
]


@pytest.mark.parametrize("joint", ["", " "])
def test_units_of_odd_texts(joint):
    some = random.Random(len(joint))
    for _ in range(6000):
        text = joint.join(some.choices(PARTS, k=some.randint(0, 14)))
        assert content_tokens(text) == plain_tokens(text), repr(text)
        assert quantities(text) == plain_quantities(text), repr(text)
        assert evidence_units(text) == plain_units(text), repr(text)


def test_long_texts_take_linear_time():
    numbers = "Sections " + "1, " * 200_000
    assert quantities(numbers) == set() and quantities("x " + numbers + "and money 7") == {"7"}
    assert len(evidence_units("a. " * 300_000)) == 0
    assert len(evidence_units("flood water. fire damage. " * 50_000)) == 50_000


def test_provenance_of_all_documents(spark, sf_dir):
    claims = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    sources = {r.doc_id: r.text for r in P.paged_documents(spark, sf_dir).collect()}
    want = plain_provenance(claims, sources)
    got = {r.claim_id: tuple(r) for r in catalog.QUERIES["v1_provenance"](spark, sf_dir).collect()}
    assert got == want and len(want) > 2
    assert any(r[2] for r in want.values())


def test_provenance_gained(spark, sf_dir):
    claims = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    rows = P.paged_documents(spark, sf_dir).collect()
    held = {(r[0], r[1]) for r in plain_provenance(claims, {r.doc_id: r.text for r in rows if r.lang == "en"}).values()}
    want = plain_provenance(claims, {r.doc_id: r.text for r in rows}, held)
    assert {r.claim_id: tuple(r) for r in catalog.QUERIES["v20_provenance_gained"](spark, sf_dir).collect()} == want


def test_provenance_of_odd_rows(spark, monkeypatch):
    some = random.Random(8)
    vocabulary = [f"word{n}" for n in range(40)] + ["$5,000", "$9", "12 percent", "Section 4", "77", "9,000"]
    sentence = lambda: " ".join(some.choices(vocabulary, k=some.randint(1, 9)))
    sources = {n: some.choice([None, "", "--- Page 2 ---"]) if n % 11 == 0 else ". ".join(sentence() for _ in range(some.randint(1, 9))) for n in range(60)}
    claims = {n: some.choice([None, "", " "]) if n % 13 == 0 else sentence() + " " + sentence() for n in range(150)}
    want = plain_provenance({k: t or "" for k, t in claims.items()}, {k: t or "" for k, t in sources.items()})
    for most in (0, 200_000):
        monkeypatch.setattr(P, "MAX_BROADCAST_ROWS", most)
        asked, common = P.claim_units(spark.createDataFrame([(k, t, "x") for k, t in claims.items()], "id long, text string, key string"), "id", "text")
        units = P.source_units(spark.createDataFrame([(k, t, "x") for k, t in sources.items()], "id long, text string, source string"), "id", "text", common)
        assert {r.claim_id: tuple(r) for r in P.provenance(asked, units).collect()} == want
    assert len(want) > 10
    missed = P.near_misses(asked, units).collect()
    plain = {}
    for claim, text in claims.items():
        words = plain_tokens((text or "").strip())
        for key, body in sorted(sources.items()):
            for n, u in enumerate(plain_units(body)):
                shared = len(words & u[2])
                if len(words) >= 4 and shared >= 4 and shared / min(len(words), len(u[2])) < 0.6:
                    plain.setdefault(claim, []).append((-shared / min(len(words), len(u[2])), key, n))
    assert {(r.claim_id, r.rank, r.source, r.position) for r in missed} == {(c, i + 1, k, n) for c, own in plain.items() for i, (_, k, n) in enumerate(sorted(own)[:3])}


def test_quantities_of_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: set(r.numbers) for r in catalog.QUERIES["t6_quantities"](spark, sf_dir).collect()}
    assert got == {k: plain_quantities(t.strip()) for k, t in texts.items() if t and t.strip()} and any(got.values())


def test_only_chosen_sources_are_written(spark, sf_dir, monkeypatch):
    """Few claims meet texts as these are read; units are kept of the sources that carry a claim only."""
    kept, source_units = [], P.source_units
    monkeypatch.setattr(P, "source_units", lambda *a: kept.append(source_units(*a)) or kept[-1])
    found = catalog.QUERIES["v1_provenance"](spark, sf_dir).select("source").distinct().count()
    assert [k.count() for k in kept] == [found] and found < table(spark, sf_dir, "documents").count()


def test_provenance_of_texts_in_one_pass_and_by_joins(spark, monkeypatch):
    claims = spark.createDataFrame([(n, t) for n, t in enumerate(["alpha beta gamma delta 77", "one two three four", None, "", "lonely words nobody else holds"])], "id long, text string")
    texts = [None, "", "--- Page 3 ---\nalpha beta. gamma delta 77. other things stand here", "alpha beta gamma delta", "one two three. four five six seven", "a b c"]
    sources = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "id long, text string, source string")
    want = plain_provenance({0: "alpha beta gamma delta 77", 1: "one two three four", 4: "lonely words nobody else holds"}, {n: t or "" for n, t in enumerate(texts)})
    assert want
    for most in (0, 200_000):
        monkeypatch.setattr(P, "MAX_BROADCAST_ROWS", most)
        asked, common = P.claim_units(claims, "id", "text")
        best = P.matching.best_of(P.fitting_windows(asked, sources, "id", "text", common))
        assert {r.claim_id: tuple(r) for r in P.provenance_of(asked, sources, "id", "text", common, best).collect()} == want
    assert P.fitting_windows(asked, sources.limit(0), "id", "text", common).count() == 0
