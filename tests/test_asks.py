"""Asks, magnitudes, translated claims, evaluation cases and picks on rows of their own."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.plans import asks as A
from tessera.sources.tables import table


def column(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, t {kind}")
    return [r.v for r in rows.select("n", expression.alias("v")).orderBy("n").collect()]


def test_shapes(spark):
    cases = [
        ("What is the deductible?", "direct"),
        ("Is it covered", "direct"),
        ("the deductible, please?", "direct"),
        ("Extract the obligations from the policy", "direct"),
        ("Write a policy", "memo"),
        ("What should the memo say?", "memo"),
        ("briefly: floods", "memo"),
        ("pull the limits and quote them", "direct"),
        ("", "memo"),
        (None, "memo"),
        ("   ", "memo"),
        ("Floods", "memo"),
    ]
    assert column(spark, A.choose_shape(F.col("t")), [c for c, _ in cases]) == [s for _, s in cases]


def test_routes(spark):
    got = column(spark, A.route(F.col("t"), F.lit(None)), ["compare a versus b", "", None, "hello there", "verify it"])
    assert [(r.task, r.has_sources, r.intent) for r in got] == [("compare", False, "compare"), ("draft", False, "unknown"), ("draft", False, "unknown"), ("draft", False, "draft"), ("audit", False, "audit")]


def test_trimmed_context(spark):
    text = "  One.  Two! Three? Four. Five "
    assert column(spark, A.trimmed(F.col("t"), head=2), [text, "", None]) == ["One. Two!", "", ""]
    assert column(spark, A.trimmed(F.col("t"), tail=2), [text, "Only", None]) == ["Four. Five", "Only", ""]
    assert column(spark, A.summary(F.col("t")), [text, " " * 300, None]) == ["One. Two!", " " * 240, ""]


def test_trimmed_context_of_all_turns(spark, sf_dir):
    split = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+", (t or "").strip()) if s.strip()]
    turns = sorted(tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect())
    want = set()
    for n, (conv, turn, _, text) in enumerate(turns):
        before = turns[n - 1][3] if n and turns[n - 1][0] == conv else None
        after = turns[n + 1][3] if n + 1 < len(turns) and turns[n + 1][0] == conv else None
        want.add((conv, turn, " ".join(split(before)[-2:]), " ".join(split(after)[:2]) or (after or "")[:240], len(split(text))))
    assert {tuple(r) for r in catalog.QUERIES["t5_trimmed_context"](spark, sf_dir).collect()} == want


def test_scale_conflicts(spark):
    cases = [
        ("a $100 billion cap", 1e8, "100 billion"),
        ("a $100 billion cap", 1e11, None),
        ("a $100 billion cap", 5.0, None),
        ("1,000 K and 2 bn", 2e3, "2 bn"),
        ("1.5m or 1.5 million", 1.5, "1.5m"),
        ("5 million and 5 thousand", 5e3, "5 million"),
        ("5 thousand and 5 million", 5e3, None),
        ("5 bits, 7 kg", 5.0, None),
        (None, 5.0, None),
    ]
    rows = spark.createDataFrame([(n, s, v) for n, (s, v, _) in enumerate(cases)], "n int, s string, v double")
    assert {r.n: r.c for r in rows.select("n", A.scale_conflict(F.col("s"), F.col("v")).alias("c")).collect()} == {n: c for n, (_, _, c) in enumerate(cases)}
    assert column(spark, A.states_a_range(F.col("t")), ["between $5 and 9", "5 to 6", "10–12", "5 and 6", "page 3"]) == [True, True, True, False, False]


def plain_claim(raw):
    found = re.search(r"\{.*\}", raw or "", re.S)
    try:
        payload = json.loads(found[0])
        operands = [(o["name"].strip(), float(o["value"]), (o.get("unit") or "").strip()) for o in payload["operands"]]
        expected = float(payload["expected"])
    except (TypeError, ValueError, KeyError, AttributeError):
        return None
    metric = str(payload.get("metric") or "").strip()
    relation = str(payload.get("relation") or "").strip().lower()
    if relation not in ("eq", "lt", "le", "gt", "ge") or any(not name for name, _, _ in operands) or not (metric or operands):
        return None
    return metric, operands, relation, expected


def test_parsed_claims(spark):
    good = {"metric": " cap ", "relation": "LT", "expected": 5, "operands": [{"name": "a", "value": "2.5", "unit": " USD"}, {"name": "b", "value": 1e3, "source_sentence": "s"}]}
    answers = [json.dumps(good), "Sure:\n" + json.dumps(good, indent=1) + "\nDone.", None, "", "no object", "{broken", '{"a": {']
    for change in (
        {"relation": "like"}, {"relation": None}, {"expected": "x"}, {"expected": None}, {"operands": None}, {"operands": []}, {"operands": [], "metric": ""},
        {"operands": [{"name": "a"}]}, {"operands": [{"value": 1}]}, {"operands": [None]}, {"operands": [{"name": "  ", "value": 1}]}, {"metric": None},
    ):
        answers.append(json.dumps(good | change))
    got = column(spark, A.parsed_claim(F.col("t")), answers)
    assert [None if r is None else (r.metric, [(o.name, o.value, o.unit) for o in r.operands], r.relation, r.expected) for r in got] == [plain_claim(a) for a in answers]
    assert sum(r is not None for r in got) == 4


def test_cases_of_datasets(spark):
    sets = [
        [{"id": "1", "reply": "The LIMIT is five", "expect_contains": ["limit", "five", "x"], "expect": " is "}],
        {"cases": [], "items": [{"id": "2", "reply": "ab", "contains": "b"}]},
        {"tests": [{"id": "3", "reply": None, "expected": "a"}, {"id": "4", "reply": "r"}]},
        {"other": 1},
        "text",
        [{"id": "5", "reply": "Straße", "expect_contains": ["STRASSE", " ", ""]}],
    ]
    frame = spark.createDataFrame([(n, json.dumps(s)) for n, s in enumerate(sets)] + [(99, None)], "k int, j string")
    cases = A.cases_of(frame, "k", "j")
    got = {r.id: (r.k, r.place, r.needles, r.score) for r in cases.withColumn("score", A.contains_score(F.col("reply"), F.col("needles"))).collect()}
    assert got == {
        "1": (0, 0, ["limit", "five", "x", "is"], 0.75),
        "2": (1, 0, ["b"], 1.0),
        "3": (2, 0, ["a"], 0.0),
        "4": (2, 1, [], 1.0),
        "5": (5, 0, ["STRASSE"], 1.0),
    }


@pytest.mark.parametrize("epsilon,least,most", [(0.0, 0, 0), (0.2, 0.12, 0.28), (1.0, 1, 1)])
def test_picks_explore_as_often_as_asked(spark, epsilon, least, most):
    rows = [(f"g{g}", f"v{v}", float(v % 3), v) for g in range(400) for v in range(5)] + [("alone", "only", 1.0, 1), (None, "x", None, None), (None, "y", 0.5, None)]
    frame = spark.createDataFrame(rows, "g string, name string, score double, uses long")
    found = A.pick(frame, "g", "name", "score", "uses", "seed", epsilon).collect()
    assert len(found) == 402 and {r.g: r.name for r in found}["alone"] == "only"
    of = [r for r in found if r.g and r.g != "alone"]
    assert least <= sum(r.explored for r in of) / 400 <= most
    assert all((r.name != "v2") == r.explored for r in of)
    if epsilon == 1.0:
        assert min(Counter(r.name for r in of).values()) > 50
    assert sorted(map(str, found)) == sorted(map(str, A.pick(frame.repartition(7), "g", "name", "score", "uses", "seed", epsilon).collect()))


def test_exports(spark, tmp_path):
    from tessera.plans import exports as E
    from tessera.sources.readers import read_texts

    block = "struct<type:string,title:string,content:string,caption:string,alt:string,src:string,language:string>"
    rows = [("a", "T & <b>", [("", [("callout", " x ", None, None, None, None, None), ("table", None, None, None, None, None, None), ("paragraph", None, " ", None, None, None, None), ("codeBlock", None, None, None, None, None, None)]), (None, [])]), ("b", "Empty", [])]
    docs = spark.createDataFrame(rows, f"name string, title string, body array<struct<title:string,children:array<{block}>>>")
    made = docs.select("name", E.to_markdown(F.col("title"), F.col("body")).alias("text"), E.to_html(F.col("title"), F.col("body"), "p{}").alias("html"))
    got = {r.name: r for r in made.collect()}
    assert got["a"].text == "# T & <b>\n\n## Section\n\n> x\n\nTable\n\n```text\n```\n\n## Section\n"
    assert got["b"].text == "# Empty\n"
    assert "<title>T &amp; &lt;b&gt;</title>\n<style>p{}</style>" in got["a"].html
    assert got["a"].html.endswith('<h2>Section</h2>\n<blockquote><p>x</p></blockquote>\n<p>Table</p>\n<pre><span class="code-lang-label">text</span><code class="language-text"></code></pre>\n<h2>Section</h2>\n</body>\n</html>\n')
    E.write_files(made, str(tmp_path / "out"))
    read = {r.path.split("name=")[1].split("/")[0]: r.text for r in read_texts(spark, [f"{tmp_path}/out/*"], "*.txt").collect()}
    assert read == {name: r.text for name, r in got.items()}
