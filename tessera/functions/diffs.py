"""Differences of two texts as expressions: where they part and meet again, their edges, the structure that an edit adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.orders import stripped
from tessera.functions.text import any_of

#: Lengths are found by halving, from this power of two down; a Spark string has fewer characters.
_POWERS = [1 << k for k in range(30, -1, -1)]

#: The structures of Markdown that are counted, and words that ask for structure.
STRUCTURES = {"headings": r"(?m)^\s{0,3}#{1,6}\s", "lists": r"(?m)^\s{0,3}(?:[-*+]|\d+[.)])\s", "bold": r"\*\*[^*]+\*\*"}
STRUCTURE_WORDS = "heading header bullet list bold italic numbered section format formatting markdown".split()


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters the two texts share at their beginning.

    The length grows by halving powers of two as long as both begin alike, so
    the texts are compared about thirty times at most, and not once for each
    character.
    """
    least = F.least(F.length(a), F.length(b))

    def grown(n: Column, power: Column) -> Column:
        more = n + power
        # Beyond the shorter text nothing is compared.
        return F.when(more > least, n).when(F.substring(a, 1, more) == F.substring(b, 1, more), more).otherwise(n)

    return F.aggregate(F.array(*[F.lit(p) for p in _POWERS]), F.lit(0), grown)


def changed_spans(a: Column, b: Column) -> Column:
    """What the two texts hold between their common beginning and end: a struct of both, trimmed; null where nothing but white space differs."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))

    def once(make: Callable[[Column], Column], **values: Column) -> Column:
        """What ``make`` gives of a struct of the values, each of which is computed once: an array of one is transformed."""
        return F.transform(F.array(F.struct(*[v.alias(name) for name, v in values.items()])), make)[0]

    def kept(text: Column, tail: Column) -> Column:
        return stripped(F.substring(text, 1, F.length(text) - tail))

    def behind(p: Column) -> Column:
        rest = lambda text: F.substring(text, p["n"] + 1, F.length(text))
        # Reversed before their end is sought, which looks at them about sixty times.
        return once(turned, left=rest(p["a"]), right=rest(p["b"]), x=F.reverse(rest(p["a"])), y=F.reverse(rest(p["b"])))

    def turned(p: Column) -> Column:
        return once(lambda q: F.struct(kept(q["left"], q["tail"]).alias("a_text"), kept(q["right"], q["tail"]).alias("b_text")), left=p["left"], right=p["right"], tail=common_prefix(p["x"], p["y"]))

    spans = once(behind, a=a, b=b, n=common_prefix(a, b))
    # Told once too, as the columns and conditions built on it would each compute it again.
    return once(lambda p: F.when((p["s"]["a_text"] != "") | (p["s"]["b_text"] != ""), p["s"]), s=spans)


def edges(text: Column) -> Column:
    """A text's white space before and behind, and what lies between; a blank text is all before."""
    raw = F.coalesce(text, F.lit(""))
    body = stripped(raw)
    before = F.when(body == "", raw).otherwise(F.substring(raw, 1, F.instr(raw, F.substring(body, 1, 1)) - 1))
    behind = F.when(body == "", "").otherwise(F.substring(raw, F.length(before) + F.length(body) + 1, F.length(raw)))
    return F.struct(before.alias("leading"), body.alias("body"), behind.alias("trailing"))


def with_edges(original: Column, proposed: Column) -> Column:
    """The proposed text between the white space that the original has around it."""
    around = edges(original)
    return F.concat(around["leading"], stripped(F.coalesce(proposed, F.lit(""))), around["trailing"])


def structure_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)) for name, pattern in STRUCTURES.items()}


def format_drift(original: Column, proposed: Column, instruction: Column) -> Column:
    """Reasons why an edit changes structure that nobody asked for; none if the instruction speaks of structure."""
    before, after = structure_counts(original), structure_counts(proposed)

    def reason(name: str) -> Column:
        was, now = before[name], after[name]
        way = F.when(now > was, "added").otherwise("removed")
        return F.when(was != now, F.concat(way, F.lit(f" {name} ("), was, F.lit(" -> "), now, F.lit(") without being asked")))

    asked = any_of(F.lower(F.coalesce(instruction, F.lit(""))), STRUCTURE_WORDS)
    none = F.array().cast("array<string>")
    return F.when(asked, none).otherwise(F.array_compact(F.array(*[reason(n) for n in STRUCTURES])))


def line_blocks(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of two lists of lines, by the greedy method of Myers (1986): linear but for the differences."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    reach, trail = {1: 0}, []
    for d in range(len(x) + len(y) + 1):
        trail.append(dict(reach))
        done = False
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            while i < len(x) and i - k < len(y) and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= len(x) and i - k >= len(y):
                done = True
                break
        if done:
            break
    pairs = [(len(a) - n, len(b) - n) for n in range(1, end + 1)]
    i, j = len(x), len(y)
    for d in range(len(trail) - 1, -1, -1):
        k, held = i - j, trail[d]
        back = k + 1 if k == -d or (k != d and held.get(k - 1, -1) < held.get(k + 1, -1)) else k - 1
        pi = held[back]
        pj = pi - back
        while i > max(pi, 0) and j > max(pj, 0) and (d == 0 or i > (pi if back == k + 1 else pi + 1)):
            i, j = i - 1, j - 1
            pairs.append((start + i, start + j))
        i, j = max(pi, 0), max(pj, 0)
    return sorted(pairs + [(n, n) for n in range(start)])


CONTEXT = 3


def _changes(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Where lines a[i:j] stand for lines b[p:q], in order, between the longest common lines."""
    found, i, p = [], 0, 0
    for j, q in [*line_blocks(a, b), (len(a), len(b))]:
        if j > i or q > p:
            found.append((i, j, p, q))
        i, p = j + 1, q + 1
    return found


def _range(start: int, stop: int) -> str:
    size = stop - start
    return str(start + 1) if size == 1 else f"{start + (size > 0)},{size}"


def unified_diff(left: str, right: str, left_name: str, right_name: str) -> str:
    """The fewest lines to take out and put in, as hunks with three lines around them; empty for equal texts."""
    a, b = left.splitlines(keepends=True), right.splitlines(keepends=True)
    hunks: list[list[tuple[int, int, int, int]]] = []
    for change in _changes(a, b):
        if hunks and change[0] - hunks[-1][-1][1] <= 2 * CONTEXT:
            hunks[-1].append(change)
        else:
            hunks.append([change])
    out = [f"--- {left_name}\n", f"+++ {right_name}\n"] if hunks else []
    for hunk in hunks:
        before = min(CONTEXT, hunk[0][0])
        after = min(CONTEXT, len(a) - hunk[-1][1])
        i, p = hunk[0][0] - before, hunk[0][2] - before
        out.append(f"@@ -{_range(i, hunk[-1][1] + after)} +{_range(p, hunk[-1][3] + after)} @@\n")
        for start, stop, new, until in hunk:
            out += [" " + line for line in a[i:start]] + ["-" + line for line in a[start:stop]] + ["+" + line for line in b[new:until]]
            i = stop
        out += [" " + line for line in a[i : i + after]]
    return "".join(out)
