"""Queries over whole tables and texts, on rows beyond what a subset or a prefix of them would hold."""

import datetime
import decimal
import hashlib
import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.units import content_tokens
from tessera.operators.copies import listed
from tessera.plans.text_queries import claim_sentences
from tessera.sources.tables import table


@pytest.fixture
def save(spark, tmp_path):
    """Writes rows as a table and returns the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def rows(spark, folder, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect())


def test_year_conflicts_of_all_runs(spark, save):
    orders = [(run, datetime.datetime(year, 3, 1)) for run, years in ((5, (1992, 1993)), (900, (1992, 1994)), (901, (1994, 1992)), (902, (1992,))) for year in years]
    folder = save("orders", orders, "o_custkey long, o_orderdate timestamp")
    assert rows(spark, folder, "j9_year_conflicts") == [(5, 900, 1, 2)]


def test_lineage_of_all_artifacts(spark, save):
    folder = save("part", [(n,) for n in range(2500)], "p_partkey long")
    want = []
    for node in range(1, 2500):
        at, depth = node, 0
        while at > 0:
            at, depth = at // 3, depth + 1
            want.append((node, at, depth))
    assert rows(spark, folder, "v24_lineage_closure") == sorted(want)


def test_sentence_numbers_of_long_documents(spark, save):
    docs = [(1, "a", "One more here. Two more here.", 29), (2, "a", "Long one here. " * 60, 900), (3, "a", "Last one here.", None), (4, "b", "Own one here.", 13)]
    folder = save("documents", docs, "doc_id long, source string, text string, n_chars long")
    got = rows(spark, folder, "w4_sentence_numbers")
    ids = {(r[0], r[1], r[2]): r[3] for r in got}
    assert len(got) == 64
    assert [ids["a", 1, 1], ids["a", 2, 0], ids["a", 2, 59], ids["a", 3, 0], ids["b", 4, 0]] == ["S2", "S3", "S62", "S63", "S1"]


def test_lint_after_the_head(spark, save):
    folder = save("documents", [(2, "word " * 100 + "formal slang it </role>")], "doc_id long, text string")
    assert rows(spark, folder, "t29_rule_lint") == [(2, False, True, True, 0, 1)]


def test_verdict_of_whole_passages(spark, save):
    claim = "The policy covers water damage. " * 10 + "The deductible is 25,000 USD and never 90,000 USD."
    save("benchmark", [(1, claim)], "item_id long, text string")
    folder = save("documents", [(7, "src1", "The policy covers water damage.")], "doc_id long, source string, text string")
    assert catalog.QUERIES["v3_evidence_verdict"](spark, folder).first().verdict != "supported"


def test_sentences_with_figures(spark, sf_dir):
    """All documents' sentences with figures, and odd ones, against a plain version."""
    odd = "- * 12 is a number. Short 1! | The rate rose to 5 %\n now ## Next: no figure here. Over " + "long " * 90 + "9 words."
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()] + [(-1, odd), (-2, None), (-3, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, tuple(r.s)) for r in frame.select("doc_id", claim_sentences(F.col("text")).alias("s")).collect())
    want = []
    for key, text in docs:
        parts = [" ".join(p.split()).strip(" \t-*#|") for p in re.split(r"(?<=[.!?])\s+", text or "")]
        want.append((key, tuple(p for p in parts if p and len(p) <= 400 and re.search(r"\d", p) and len(re.findall(r"\w+", p)) >= 3)))
    assert got == sorted(want)
    assert any(s for key, s in got if key >= 0)


def test_running_means_of_all_keys(spark, sf_dir):
    """a16 folds each key's values in order, rounding at each step as the database does."""
    events = sorted((r.user_id, r.ts, r.event_id, r.value) for r in table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").collect())
    want = {}
    for user, _, _, x in events:
        mean, n = want.get(user, (0.0, 0))
        want[user] = (float(decimal.Decimal(repr((mean * n + x) / (n + 1))).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP)), n + 1)
    got = {r.user_id: (r.score, r.uses) for r in catalog.QUERIES["a16_running_mean"](spark, sf_dir).collect()}
    assert got == want


def test_spans_of_confidence(spark, sf_dir):
    """v12 covers each passage with sentence units, low where a violated key stands in one."""
    texts = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()}
    want = set()
    for key, text in texts.items():
        for n, m in enumerate(re.finditer(r"[^.!?]+[.!?]|[^.!?]+$", text)):
            low = any(v in m[0].lower() for v in ("the", "license"))
            want.add((key, n, len(m[0]), 0.25 if low else 0.85))
    got = {(r.item_id, r.position, r.end - r.start, r.confidence) for r in catalog.QUERIES["v12_confidence_spans"](spark, sf_dir).collect()}
    assert got == want


def test_listed_rows(spark):
    rows = spark.range(3000).toDF("k")
    assert sorted(r.k for r in listed(rows, "k", [5, 5, 7, 9999]).collect()) == [5, 7]
    assert listed(rows, "k", list(range(0, 6000, 3)) * 2).count() == 1000
    assert listed(rows, "k", []).count() == 0


def test_content_tokens_of_all_turns(spark, sf_dir):
    """t2 against the tokens that evidence units have, read by Python's own classes of letters."""
    turns = {(r.conv_id, r.turn): r.text for r in table(spark, sf_dir, "conversations").collect()}
    got = {(r.conv_id, r.turn): r.tokens for r in catalog.QUERIES["t2_content_tokens"](spark, sf_dir).collect()}
    assert got == {k: sorted(content_tokens(t)) for k, t in turns.items()}


def test_normalised_texts(spark, sf_dir, save):
    """t15 step by step on all documents and odd ones, written plainly."""
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    docs += [(-1, "A\x00b\x07 \t c\n\n\n\nPage 12\n  CONFIDENTIAL \n draft\nx\n"), (-2, ""), (-3, "  a  ")]
    want = set()
    for key, text in docs:
        plain = "".join(c for c in text if c in "\n\t" or unicodedata.category(c)[0] != "C")
        plain = re.sub(r"(?im)^\s*(?:page \d+|confidential|draft)\s*$", "", plain)
        plain = re.sub("[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", plain)).strip(" ")
        want.add((key, len(plain), hashlib.sha256(plain.encode()).hexdigest()))
    folder = save("documents", docs, "doc_id long, text string")
    assert {tuple(r) for r in catalog.QUERIES["t15_normalised"](spark, folder).collect()} == want


class PlainPage(HTMLParser):
    """A page by the standard library's events: what is open is counted, and data taken or not."""

    SKIPPED = "script style noscript template svg iframe nav footer header aside form button select option".split()

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.title, self.all, self.main = Counter(), [], [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.open[tag] = 1 if tag == "title" else self.open[tag] + 1

    def handle_endtag(self, tag):
        kind = self.SKIPPED if tag in self.SKIPPED else ["main", "article"] if tag in ("main", "article") else [tag]
        for name in [tag, *kind]:
            if self.open[name]:
                self.open[name] -= 1
                return

    def handle_data(self, data):
        if self.open["title"]:
            self.title.append(data)
        elif not any(self.open[t] for t in self.SKIPPED) and data.strip():
            self.all.append(data.strip())
            if self.open["main"] or self.open["article"]:
                self.main.append(data.strip())


def test_pages_by_the_standard_parser(spark, sf_dir):
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    got = {r.page_id: (r.title, r.text) for r in catalog.QUERIES["s10_page_text"](spark, sf_dir).collect()}
    for key, html in pages.items():
        page = PlainPage(html or "")
        main = " ".join(page.main)
        lines = (" ".join(line.split()) for line in (main if len(main) >= 200 else " ".join(page.all)).splitlines())
        assert got[key] == (" ".join(" ".join(page.title).split()), "\n".join(line for line in lines if line)), key
    assert set(got) == set(pages)
