"""Trees of any depth, bounds, document scans and text differences on rows of their own."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import diffs as D
from tessera.plans import bounds as B
from tessera.plans import document_scan as S
from tessera.plans import node_trees as T


def some_tree(some, depth):
    return [
        some.choice([5, "text", None])
        if some.random() < 0.1
        else {
            "id": some.choice(["a", "", f"n{some.randint(0, 99)}"]),
            "type": "paragraph",
            **({"annotations": {"redhat": [{}] * some.randint(0, 3)}} if some.random() < 0.5 else {}),
            **({"children": some_tree(some, depth - 1)} if depth and some.random() < 0.7 else {}),
        }
        for _ in range(some.randint(0, 3))
    ]


def plain_nodes(children, path=()):
    for place, node in enumerate([n for n in children if isinstance(n, dict)]):
        yield (*path, place), node
        yield from plain_nodes(node.get("children") or [], (*path, place))


def test_trees_of_any_depth(spark):
    some = random.Random(2)
    trees = {n: some_tree(some, n % 9) for n in range(60)}
    chain = {"id": "end"}
    for n in range(70):
        chain = {"id": f"c{n}", "children": [chain]}
    trees[100] = [chain]
    rows = [(k, json.dumps({"body": body})) for k, body in trees.items()] + [(200, None), (201, "no json"), (202, "{}"), (203, '{"body": 5}')]
    frame = spark.createDataFrame(rows, "k long, tree string")
    walked = T.walk(frame, "k", "tree").cache()
    want = {(k, ".".join(map(str, p)), len(p), n["id"]) for k, body in trees.items() for p, n in plain_nodes(body)}
    assert {(r.k, r.path, r.depth, r.id) for r in T.all_nodes(walked, "k").collect()} == want
    assert max(depth for _, _, depth, _ in want) == 71
    counts = {k: (len(list(plain_nodes(b))), sum(len((n.get("annotations") or {}).get("redhat") or []) for _, n in plain_nodes(b))) for k, b in trees.items()}
    counts |= {k: (0, 0) for k in (200, 201, 202, 203)}
    assert {r.k: (r.nodes, r.findings) for r in T.node_counts(frame, walked, "k").collect()} == counts
    blocks = {(k, *p, n["id"]) for k, b in trees.items() for p, n in plain_nodes(b) if len(p) == 2 and n["id"]}
    assert {(r.k, r.section, r.place, r.id) for r in T.block_nodes(walked, "k").collect()} == blocks


OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def test_bounds_against_trying_values(spark):
    some = random.Random(9)
    locks = [(some.choice(["l1", "l2", "l3", "l4", None]), f"k{some.randint(0, 12)}", some.choice([*OPS, "~"]), some.choice([0.0, 1.0, 2.0, 3.0, None, float("nan")]), n) for n in range(150)]
    claims = [(n, some.choice(["l1", "l2", "l3", "l4", "l5", None]), f"k{some.randint(0, 14)}", some.choice([0.0, 0.5, 1.0, 2.0, 3.5, None])) for n in range(300)]
    usable = [x for x in locks if x[2] in OPS and x[3] is not None and x[3] == x[3]]
    tries = [v / 4 for v in range(-4, 20)]
    own = {}
    for ledger, key, op, value, place in usable:
        own.setdefault((ledger, key), []).append((place, op, value))
    empty = {ledger for (ledger, _), ls in own.items() if not any(all(OPS[op](t, v) for _, op, v in ls) for t in tries)}
    want = {}
    for n, ledger, key, value in claims:
        ls = own.get((ledger, key), [])
        bad = None if value is None else ledger in empty or any(not OPS[op](value, v) for _, op, v in ls)
        want[n] = (bad, *(max(ls)[1:] if bad and ls else (None, None)))
    lock_rows = spark.createDataFrame(locks, "ledger string, key string, op string, value double, place long").where("value IS NULL OR NOT isnan(value)")
    claim_rows = spark.createDataFrame(claims, "claim_id long, ledger string, key string, value double")
    got = {r.claim_id: (r.contradicts, r.locked_op, r.locked_value) for r in B.check_values(claim_rows, lock_rows).collect()}
    assert got == want
    assert {None, True, False} == {w[0] for w in want.values()}


@pytest.mark.parametrize(
    "locks,empty",
    [
        ([("<", 1.0), (">", 1.0)], True),
        ([("<=", 1.0), (">=", 1.0)], False),
        ([("<=", 1.0), (">=", 1.0), ("!=", 1.0)], True),
        ([("<", 1.0), (">=", 1.0)], True),
        ([("<", 1.0), ("<=", 1.0)], False),
        ([("==", 1.0), ("==", 2.0)], True),
        ([("!=", 1.0), ("!=", 2.0)], False),
        ([(">", 1.0), ("<", 2.0), ("!=", 1.5)], False),
    ],
)
def test_what_bounds_leave(spark, locks, empty):
    rows = spark.createDataFrame([("l", "k", op, v) for op, v in locks], "ledger string, key string, op string, value double")
    assert B.intervals(rows).first().empty == empty


NODE = "document_id long, node_id string, position long, type string, text string, entities array<string>, cited boolean, pills boolean, z3 array<struct<status:string,message:string>>, redhat array<struct<status:string,message:string>>"


def test_scan_of_a_document(spark):
    nodes = [
        (1, "a", 1, "paragraph", "limit = 5M and Limit: $3k\nlimit", ["limit"], False, False, [], []),
        (1, "b", 2, "paragraph", "= 7, paid $1,500 then $2.5 million now", ["limit", "floor"], True, False, [("violation", ""), ("ok", "x")], [("", " Unsupported words "), ("resolved", "no"), (None, "minor")]),
        (1, "c", 3, "callout", "floor: 9 floor: 8 [🔒 #12] $50", ["floor"], False, False, [], []),
        (1, "d", 4, "paragraph", "x" * 130 + " 4", None, False, False, [], []),
        (1, "d", 4, "paragraph", "x" * 130 + " 4", None, False, False, [], []),
        (2, "", 1, "paragraph", None, None, None, None, None, None),
        (3, "z", 1, "paragraph", "$,,, and $ 20 thousand", ["limit"], False, True, [], []),
    ]
    ledger = [(1, "limit", 5e6, 0), (1, " floor ", 9.0, 1), (1, "bad", None, 2), (3, "cap_of_b-site", 100.5, 0)]
    got = S.scan_documents(spark.createDataFrame(nodes, NODE), spark.createDataFrame(ledger, "document_id long, key string, value double, place long")).collect()
    rows = {(r.document_id, r.id): (r.severity, r.category, r.description, r.node_id) for r in got}
    snippet = "x" * 117 + "..."
    number = "in the Main document has no verified lock pill or substrate citation."
    over = "Aggregate liability limit exceeds Floor by $"
    want = [
        ("high", "Z3 Contradiction", "Metric 'limit'=7.0 contradicts locked == 5000000.0", None),
        ("high", "Z3 Contradiction", "Z3 constraint violation", "b"),
        ("high", "Z3 Contradiction", "Metric 'floor'=8.0 contradicts locked == 9.0", "c"),
        ("high", "Red-Hat Finding", "Unsupported words", "b"),
        ("high", "Unverified Number", f"Numeric claim $3k {number}", "a"),
        ("high", "Unverified Number", f"{over}2,991.", "a"),
        ("high", "Unverified Number", f"{over}1,491.", "b"),
        ("high", "Unverified Number", f"{over}2,499,991.", "b"),
        ("high", "Unverified Number", f"{over}41.", "c"),
        ("medium", "Red-Hat Finding", "minor", "b"),
        ("medium", "Unverified Number", "Numeric claim $2.5 million is cited but not bound to a verified lock pill.", "b"),
        ("medium", "Missing Citation", 'Paragraph contains verifiable numbers but no citation: "limit = 5M and Limit: $3k\nlimit"', "a"),
        ("medium", "Missing Citation", f'Paragraph contains verifiable numbers but no citation: "{snippet}"', "d"),
    ]
    assert [rows[1, f"issue-{n:02d}"] for n in range(1, 14)] == want and len([k for k in rows if k[0] == 1]) == 13
    assert {v[2] for k, v in rows.items() if k[0] == 3} == {"Aggregate liability limit exceeds Cap Of B-Site by $19,900."}


def plain_span(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    x, y = a[n:], b[n:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    return (x.strip(), y.strip()) if x.strip() or y.strip() else None


def test_spans_and_edges(spark):
    some = random.Random(3)
    text = lambda: "".join(some.choices(["a", "b", " ", "é", "😀", "\n", "ab ab"], k=some.randint(0, 12)))
    pairs = [(t, t[: len(t) // 2] + text() + t[len(t) // 2 :]) if n % 2 else (t, text()) for n, t in enumerate(text() for _ in range(400))] + [("", ""), ("a", "a"), ("aXa", "aYYa"), ("x" * 5000 + "1", "x" * 5000 + "2")]
    frame = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n long, a string, b string")
    span = D.changed_spans(F.col("a"), F.col("b"))
    for r in frame.select("n", "a", "b", D.common_prefix(F.col("a"), F.col("b")).alias("p"), span.alias("s"), D.edges(F.col("a")).alias("e"), D.with_edges(F.col("a"), F.col("b")).alias("w")).collect():
        assert (tuple(r.s) if r.s else None) == plain_span(r.a, r.b)
        assert (r.e.leading + r.e.body + r.e.trailing, r.e.body) == (r.a, r.a.strip())
        lead = r.a[: len(r.a) - len(r.a.lstrip())]
        tail = r.a[len(r.a.rstrip()) :] if r.a.strip() else ""
        assert r.w == lead + r.b.strip() + tail


def test_format_drift(spark):
    cases = [
        ("plain", "# Head\nplain", "shorten", ["added headings (0 -> 1) without being asked"]),
        ("- a\n2) b **c**", "a b c", "shorten", ["removed lists (2 -> 0) without being asked", "removed bold (1 -> 0) without being asked"]),
        ("plain", "# Head", "Add a HEADING", []),
        (None, "x", None, []),
    ]
    frame = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(cases)], "n int, a string, b string, i string")
    got = {r.n: r.d for r in frame.select("n", D.format_drift(F.col("a"), F.col("b"), F.col("i")).alias("d")).collect()}
    assert got == {n: c[3] for n, c in enumerate(cases)}


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_line_blocks_are_longest():
    some = random.Random(7)
    for n in range(3000):
        letters = "ab" if n % 2 else "abcdefg"
        a, b = (some.choices(letters, k=some.randint(0, 9)) for _ in range(2))
        pairs = D.line_blocks(a, b)
        assert len(pairs) == lcs(a, b), (a, b, pairs)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    long = [str(n) for n in range(20_000)]
    other = long[:500] + ["new"] + long[500:19_000] + long[19_010:]
    assert len(D.line_blocks(long, other)) == 19_990
    assert difflib.SequenceMatcher(None, "ab", "ab").ratio() == 1


def test_unified_diffs():
    """Hunks rebuild the right text from the left one, and agree with the library's form where its matching is the longest."""
    some = random.Random(11)
    for n in range(1500):
        letters = [f"{c}\n" for c in ("abcdefghijklmnop" if n % 2 else "ab")]
        a = "".join(some.choices(letters, k=some.randint(0, 30)))
        b = "".join(x for x in a.splitlines(keepends=True) if some.random() > 0.1) + "".join(some.choices(letters, k=some.randint(0, 2)))
        got = D.unified_diff(a, b, "l", "r")
        left, out, at = a.splitlines(keepends=True), [], 0
        lines = got.splitlines(keepends=True)[2:]
        for line in lines:
            if line.startswith("@@"):
                start, _, size = line.split()[1][1:].partition(",")
                first = int(start) - (size != "0")
                out += left[at:first]
                at = first
            else:
                at += line[0] in " -"
                out += [line[1:]] * (line[0] in " +")
        assert "".join(out + left[at:]) == b
        want = "".join(difflib.unified_diff(left, b.splitlines(keepends=True), "l", "r"))
        changed = lambda t: sum(x[0] in "+-" for x in t.splitlines()[2:])
        assert changed(got) <= changed(want)
    a, b = "".join(f"{n}\n" for n in range(40)), "".join(f"{n}\n" for n in range(40) if n not in (5, 9, 30)) + "end"
    assert D.unified_diff(a, b, "l", "r") == "".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), "l", "r"))
    assert D.unified_diff(a, a, "l", "r") == "" and D.unified_diff("", "x", "l", "r") == "--- l\n+++ r\n@@ -0,0 +1 @@\n+x"


def test_spans_are_computed_once(spark, sf_dir):
    """The two common ends are sought once a row, in texts that are reversed once, however many columns are read of the result."""
    from tessera import catalog

    plan = catalog.QUERIES["t24_changed_spans"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 and plan.count("reverse(") == 2


def test_a_node_is_read_once(spark):
    """What queries ask of a node comes from the reading of its level: no JSON is left to be parsed after the walk."""
    frame = spark.createDataFrame([(1, '{"body": [{"id": "a", "children": [{"id": 7, "type": null, "annotations": {"redhat": 3}}]}, 5, {"children": {}}]}')], "k long, tree string")
    walked = T.walk(frame, "k", "tree")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (T.all_nodes(walked, "k"), T.node_counts(frame, walked, "k"), T.block_nodes(walked, "k"))]
    assert not [p for p in plans if "json" in p.lower()]
    assert {(r.path, r.id, r.type) for r in T.all_nodes(walked, "k").collect()} == {("0", "a", None), ("0.0", "7", None), ("1", None, None)}
    assert [(r.nodes, r.findings) for r in T.node_counts(frame, walked, "k").collect()] == [(3, 0)]


def test_scans_in_many_parts(spark, sf_dir, monkeypatch):
    """However few nodes a task gets, documents and their locks meet and are numbered as a whole."""
    whole = sorted(map(str, S.scan_documents(*S.order_documents(spark, sf_dir)).collect()))
    monkeypatch.setattr(S, "NODES_A_TASK", 400)
    found = S.scan_documents(*S.order_documents(spark, sf_dir))
    assert found.rdd.getNumPartitions() > 4 and sorted(map(str, found.collect())) == whole
