"""Rules of single functions on small rows."""

import decimal
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.functions import text as X
from tessera.operators.analytics import running_mean
from tessera.operators.windows import merge_short, running_totals, sentence_windows, source_budget, source_carry
from tessera.plans import conflicts
from tessera.plans.anchor import anchors, claims_of
from tessera.plans.conflicts import ancestors
from tessera.plans.evidence import excerpts, judge
from tessera.plans.ledger import check_relations, facts_of
from tessera.sources.readers import page_text, read_cases, read_texts


def value(spark, column, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return frame.select(column.alias("v")).first().v


#: Claims, sources and the verdict that follows.
VERDICTS = [
    ("The warranty includes battery repairs", "The warranty excludes battery repairs.", "contradicted"),
    ("Shipping takes 12 working days", "Shipping takes 30 working days.", "contradicted"),
    ("Visitors are allowed inside the reactor hall", "Visitors are not allowed inside the reactor hall.", "contradicted"),
    ("The bridge carries freight trains", "The bridge carries freight trains.", "supported"),
    ("Harvest workers receive monthly bonuses", "Harvest workers receive weekly meals.", "partial"),
    ("Violins were tuned before sunrise", "Shipping takes 12 working days.", "not_supported"),
]


@pytest.mark.parametrize("claim,source,expected", VERDICTS)
def test_verdicts(spark, claim, source, expected):
    claims = spark.createDataFrame([(1, "p", claim)], "claim_id long, project string, claim string")
    sources = spark.createDataFrame([(7, "p", source)], "doc_id long, project string, text string")
    kept = excerpts(sources, "project", "doc_id", "text")
    assert judge(claims, kept, "project", "doc_id").first().verdict == expected


def test_claims_of_projects_without_sources(spark):
    claims = spark.createDataFrame([(1, "north", "Herons nest along the canal")], "claim_id long, project string, claim string")
    sources = spark.createDataFrame([(7, "south", "Herons nest along the canal.")], "doc_id long, project string, text string")
    assert judge(claims, excerpts(sources, "project", "doc_id", "text"), "project", "doc_id").first().verdict == "unanchored"


def test_excerpts_carry_the_first_texts(spark):
    rows = [(n, "g", "x" * 3000) for n in range(8)] + [(8, "g", "   "), (9, None, "alone")]
    kept = excerpts(spark.createDataFrame(rows, "doc_id long, project string, text string"), "project", "doc_id", "text").collect()
    assert sorted((r.doc_id, r["rank"], len(r.excerpt)) for r in kept) == [(0, 1, 3000), (1, 2, 3000), (2, 3, 3000), (3, 4, 3000), (4, 5, 3000), (5, 6, 1000)]


def test_running_totals_over_many_partitions(spark):
    rows = [(g, n, n % 5) for g, size in (("a", 60), ("b", 7), (None, 3)) for n in range(size)]
    got = running_totals(spark.createDataFrame(rows, "g string, k int, v int"), "g", "k", "v").collect()
    assert {(r.g, r.k): r.ahead for r in got} == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}


def test_content_tokens(spark):
    got = value(spark, F.array_sort(X.content_tokens(F.col("t"))), t="The limit is $1,234.50 or 5 percent für Ä-Werk $5,000,000")
    assert got == sorted(["limit", "money1234", "pct5", "für", "werk", "money5000000"])


def test_anchor_prefers_the_narrow_window(spark):
    text = "Intro words come first here. The deductible amount equals two thousand dollars. Payment follows within thirty days afterwards."
    sources = spark.createDataFrame([(3, text)], "doc_id long, text string")
    claims = claims_of(spark.createDataFrame([(1, "The deductible amount equals two thousand dollars")], "id long, text string"), "id", "text")
    row = anchors(claims, sources, "doc_id", "text").first()
    assert (row.source, row.start, row.width, row.score) == (3, 1, 1, 1.0)


def test_anchor_needs_the_claims_numbers(spark):
    sources = spark.createDataFrame([(3, "The deductible amount equals 5000 dollars always")], "doc_id long, text string")
    claims = claims_of(spark.createDataFrame([(1, "The deductible amount equals 2500 dollars always")], "id long, text string"), "id", "text")
    assert anchors(claims, sources, "doc_id", "text").count() == 0


def test_ambiguous_names_are_unknown(spark):
    locks = spark.createDataFrame([("east depot", "spare rotors", 8.0), ("west depot", "spare rotors", 13.0)], "canonical_key string, metric string, value double")
    claims = spark.createDataFrame(
        [(1, "spare rotors", "x", "eq", 8.0, 8.0), (2, "East depot", "x", "eq", 8.0, 8.0), (3, "west depot", "x", "eq", 8.0, 8.0), (4, "east depot", "x", "gt", 8.0, 8.0)],
        "claim_id long, operand string, metric string, relation string, claimed double, expected double",
    )
    got = {r.claim_id: r.verdict for r in check_relations(claims, facts_of(locks)).collect()}
    assert got == {1: "UNKNOWN", 2: "VERIFIED", 3: "VIOLATED", 4: "UNKNOWN"}


def test_windows_and_merging(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "id long, sentences array<string>")
    assert sorted(r.window for r in sentence_windows(rows, "id").collect()) == ["a", "a b", "a b c", "b", "b c", "c"]
    assert value(spark, merge_short(F.array(*[F.lit(s) for s in ("one two", "three four five", "six")]), 4), t="") == ["one two three four five", "six"]


def test_running_mean_rounds_each_step(spark):
    rows = spark.createDataFrame([("k", 1, 1 / 3), ("k", 2, 2 / 3), ("k", 3, 0.1)], "key string, at int, x double")
    mean = 0.0
    for n, x in enumerate((1 / 3, 2 / 3, 0.1)):
        mean = round((mean * n + x) / (n + 1), 4)
    assert running_mean(rows, "key", ("at",), "x").first().score == mean


def test_page_text():
    inner = " ".join(f"oak{n}" for n in range(60))
    page = f"<!DOCTYPE html><html><head><title> Tall\n trees </title><style>p > b {{}}</style><script>if (a<b) x</script></head><body><!-- <p>no</p> --><header>top</header><ARTICLE>{inner}<br>end &amp; &eacute;</ARTICLE>rest</body></html>"
    assert page_text(page) == ("Tall trees", f"{inner} end & \u00e9")
    assert page_text("<p title='a>b'>little <nav>menu<p>deep</nav> more</b>") == ("", "little more")
    assert page_text("plain, 1 < 2") == ("", "plain, 1 < 2")
    assert page_text("<script>never closed") == ("", "")
    assert page_text(None) == page_text("") == ("", "")


def test_page_text_keeps_lines_and_is_linear():
    assert page_text("<body>one\n two  x<p>three\n\n\n four</p></body>") == ("", "one\ntwo x three\nfour")
    assert page_text("a</nav>b<nav>c<nav>d</nav>e</nav>f<header/>g") == ("", "a b f g")
    start = time.perf_counter()
    assert page_text("<p>x" * 100_000)[1] == " ".join("x" * 100_000)
    assert time.perf_counter() - start < 5


def test_running_mean_of_odd_rows(spark):
    rows = [("b", n, 1.00005 * n) for n in range(3000)] + [("a", 1, 2.0), ("a", 2, None), ("a", 3, 1.0), (None, 1, 4.0)]
    got = {r.key: (r.score, r.uses) for r in running_mean(spark.createDataFrame(rows, "key string, at int, x double"), "key", ("at",), "x").collect()}
    mean = 0.0
    for n in range(3000):
        mean = float(decimal.Decimal(repr((mean * n + 1.00005 * n) / (n + 1))).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP))
    assert got == {"a": (None, 3), "b": (mean, 3000), None: (4.0, 1)}


def test_ancestors_of_cycles_and_long_chains(spark):
    links = [(n, n + 1) for n in range(100)] + [(200, 201), (201, 202), (202, 201), (300, None)]
    got = {(r.node, r.ancestor): r.depth for r in ancestors(spark.createDataFrame(links, "node long, parent long")).collect()}
    want = {(a, b): b - a for a in range(100) for b in range(a + 1, 101)}
    want |= {(200, 201): 1, (200, 202): 2, (201, 202): 1, (201, 201): 2, (202, 201): 1, (202, 202): 2}
    assert got == want


def test_merged_sentences_are_linear(spark):
    parts = ["a b"] * 50_000 + ["c d e"]
    got = spark.createDataFrame([(1, parts), (2, None), (3, [])], "k int, p array<string>").select("k", merge_short(F.col("p"), 4).alias("m")).collect()
    assert {r.k: r.m for r in got} == {1: [" ".join(parts)], 2: None, 3: []}


def test_budgets_of_groups_over_many_partitions(spark):
    rows = [("a", n, 3000) for n in range(50)] + [(None, 1, 7), ("b", 1, None)]
    frame = spark.createDataFrame(rows, "g string, k long, chars long")
    got = {(r.g, r.k): (r.carried, r.truncated) for r in source_budget(frame.repartition(9), "g", [F.col("k")], "chars").collect()}
    assert [got["a", n][0] for n in range(7)] == [3000] * 5 + [1000, 0] and got["a", 5] == (1000, True) and got[None, 1] == (7, False)
    assert {(r.g, r.k): r.carried for r in source_carry(frame, "g", [F.col("k")], "chars", total=9000).collect()}["a", 3] is False


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9")
    (tmp_path / "b.bad").write_bytes(b"a\xffb\xe2\x82")
    bad = b"a\xffb\xe2\x82".decode("utf-8", errors="replace")
    assert [r.text for r in read_texts(spark, [str(tmp_path)], "*.bad").collect()] == [bad]
    (tmp_path / "cases.json").write_text('{"cases": [{"id": 1, "task": "t"}, {"id": 2, "task": "u"}]}')
    assert [r.text for r in read_texts(spark, [str(tmp_path)], "*.txt").collect()] == ["café"]
    assert sorted(r.id for r in read_cases(spark, str(tmp_path / "cases.json")).collect()) == [1, 2]


def test_each_ancestor_is_written_once(spark, monkeypatch):
    """Random links with shorter ways and cycles, against a search from each node; no round writes again what is known."""
    some = random.Random(8)
    links = sorted({(some.randint(0, 40), some.randint(0, 40)) for _ in range(70)}) + [(n, n + 1) for n in range(100, 137)]
    parents = {}
    for node, parent in links:
        parents.setdefault(node, set()).add(parent)
    want = {}
    for node in parents:
        edge, depth = {node}, 0
        while edge := {p for n in edge for p in parents.get(n, ())} - {a for n, a in want if n == node}:
            depth += 1
            want |= {(node, a): depth for a in edge}
    sizes = []

    def counted(df):
        kept = storage.written(df)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(conflicts, "written", counted)
    rows = ancestors(spark.createDataFrame([*links, (50, None)], "node long, parent long")).collect()
    assert len(rows) == len(want) == sum(sizes) and {(r.node, r.ancestor): r.depth for r in rows} == want
