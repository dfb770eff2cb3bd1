"""The text functions as SQL expressions, for the SQL that queries are checked against."""

from __future__ import annotations

from tessera.functions.text import ANTONYMS, CONTRADICTIONS, DISTINGUISHING, NEGATIONS, OPPOSING_NEGATIONS, OVERLAP_STOPWORDS, STOPWORDS


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[a-z0-9]+')"


def content_words(t: str) -> str:
    return f"list_distinct(list_filter({words(t)}, lambda w: length(w) > 2 AND w NOT IN ({quoted(STOPWORDS)})))"


def evidence_tokens(t: str, longer_than: int = 1) -> str:
    return f"list_filter(regexp_extract_all({t}, '[A-Za-z0-9_%$.]+'), lambda w: length(w) > {longer_than})"


def lowered(tokens: str) -> str:
    return f"list_transform({tokens}, lambda w: lower(w))"


def sentences(t: str) -> str:
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"list_filter(list_transform(string_split_regex({t}, '[.!?\n]+'), lambda s: trim(s, {blanks})), lambda s: s <> '')"


def plain_numbers(t: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({t}, '[0-9]+(?:[,0-9]*)(?:\.[0-9]+)?'), lambda n: rtrim(replace(n, ',', ''), '.')))"


def signed_numbers(t: str) -> str:
    return rf"regexp_extract_all({t}, '-?[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?')"


def any_of(t: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {quoted([p])})" for p in phrases) + ")"


def boosted_overlap(c: str, e: str) -> str:
    tokens, there = lowered(evidence_tokens(c)), lowered(evidence_tokens(e))
    core = f"list_distinct(list_filter({tokens}, lambda w: (regexp_full_match(w, '[0-9]+') OR length(w) > 3) AND w NOT IN ({quoted(OVERLAP_STOPWORDS)})))"
    bare = "regexp_replace(w, '[MBKmbk%]+$', '')"
    hits = f"len(list_filter({core}, lambda w: list_contains({there}, w) OR list_contains(list_transform({there}, lambda w: {bare}), {bare})))"
    phrase = f"CASE WHEN contains(array_to_string({there}, ' '), array_to_string({tokens}, ' ')) THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END"
    number = f"CASE WHEN list_has_any({signed_numbers(c)}, {signed_numbers(e)}) THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END"
    share = f"CASE WHEN len({core}) > 0 THEN 100.0::DOUBLE * {hits} / len({core}) ELSE 0.0::DOUBLE END"
    return f"CASE WHEN len({tokens}) > 0 AND trim({e}) <> '' THEN least(100.0::DOUBLE, {share} + {phrase} + {number}) ELSE 0.0::DOUBLE END"


def weighted_match(c: str, e: str) -> str:
    tokens = lowered(evidence_tokens(c, 3))
    there = lowered(f"regexp_extract_all({e}, '[A-Za-z0-9_%$.]+')")
    weight = f"CASE WHEN w IN ({quoted(DISTINGUISHING)}) OR list_contains({plain_numbers(c)}, w) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    total = f"coalesce(list_sum(list_transform({tokens}, lambda w: {weight})), 0)"
    matched = f"coalesce(list_sum(list_transform({tokens}, lambda w: CASE WHEN list_contains({there}, w) THEN {weight} ELSE 0.0::DOUBLE END)), 0)"
    n, m = plain_numbers(c), plain_numbers(e)
    apart = f"(len({n}) > 0 AND len({m}) > 0 AND NOT list_has_any({n}, {m}))"
    parity = f"({any_of(f'lower({c})', NEGATIONS)} <> {any_of(f'lower({e})', NEGATIONS)})"
    return f"CASE WHEN {total} > 0 THEN (CASE WHEN {apart} OR {parity} THEN least({matched}, {total} * 0.5::DOUBLE) ELSE {matched} END) / {total} ELSE 0.0::DOUBLE END"


def opposes(c: str, e: str) -> str:
    cl, el = f"lower({c})", f"lower({e})"
    blank = lambda t: rf"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda w: length(w) > 3)"
    positive = f"replace({cl}, {quoted([OPPOSING_NEGATIONS[-1]])}, '')"
    negation = f"({any_of(cl, OPPOSING_NEGATIONS)} <> {any_of(el, OPPOSING_NEGATIONS)} AND len(list_filter({blank(positive)}, lambda w: contains({el}, w))) > 0)"
    own, other = f"regexp_extract_all({cl}, '[A-Za-z0-9_%$.]+')", f"regexp_extract_all({el}, '[A-Za-z0-9_%$.]+')"
    pair_list = ", ".join(f"['{x}', '{y}']" for x, y in ANTONYMS)
    pairs = f"len(list_filter([{pair_list}], lambda p: (list_contains({own}, p[1]) AND list_contains({other}, p[2])) OR (list_contains({own}, p[2]) AND list_contains({other}, p[1])))) > 0"
    n, m = plain_numbers(c), plain_numbers(e)
    number = f"(len({n}) > 0 AND len({m}) > 0 AND NOT list_has_any({n}, {m}))"
    phrase = f"({any_of(el, CONTRADICTIONS)} AND len(list_filter({blank(el)}, lambda w: contains({cl}, w))) > 0)"
    return f"({negation} OR {pairs} OR {number} OR {phrase})"
