"""Column functions on text: tokenisers, sentences, numbers, facts, overlaps, scans.

Classes in patterns are spelled out in ASCII where a result is checked in SQL:
what ``\\w`` means differs between regular expression engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the content tokeniser leaves out.
STOPWORDS = "a an the of and or to in on for is are was were be by with as at this that it its from but shall will may any all".split()

#: Words that overlap scores leave out.
OVERLAP_STOPWORDS = (
    "in the and of to for with on at by from as is was were be been have has had will would could should may might must shall can do did does "
    "am are or but not a an this that these those it its their our your my his her him she he we they us them"
).split()


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def folded(text: Column) -> Column:
    """The text without differences of case, sharp s as two letters."""
    return F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case, repeats included."""
    return all_matches(F.lower(text), "[a-z0-9]+")


def evidence_tokens(text: Column, longer_than: int = 1) -> Column:
    """Runs of letters, digits and ``_ % $ .`` with more than so many characters."""
    return F.filter(all_matches(text, "[A-Za-z0-9_%$.]+"), lambda t: F.length(t) > longer_than)


def quality_words(text: Column) -> Column:
    """Distinct runs of at least two of a-z and 0-9, of the text in lower case."""
    return F.array_distinct(all_matches(F.lower(text), "[a-z0-9]{2,}"))


def content_words(text: Column) -> Column:
    """Distinct words of the text with more than two characters that aren't stop words."""
    return F.array_except(all_matches(F.lower(text), "[a-z0-9]{3,}"), F.array(*[F.lit(w) for w in STOPWORDS]))


def content_tokens(text: Column) -> Column:
    """Content words over all scripts, with amounts of money and percentages as single tokens.

    ``$1,234.50`` is money1234 (marks part words) and ``5 percent`` pct5; letters count in
    every script, so SQL without Unicode classes cannot follow.
    """
    digits = lambda n: F.regexp_replace(n, ",", "")
    # Amounts are rewritten one by one: each match stands at its place among the split's pieces.
    def rewrite(t: Column, pattern: str, make) -> Column:
        found = all_matches(t, pattern, 1)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), F.array_append(F.transform(found, make), F.lit("")), lambda gap, token: F.concat(gap, token)), "")

    def money(n: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(digits(n), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.concat(F.lit(" money"), F.regexp_replace(plain, "^0+(?=[0-9])", ""), F.lit(" "))

    raw = rewrite(F.coalesce(text, F.lit("")), r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", money)
    raw = rewrite(raw, r"(?i)(?<![\p{L}\p{N}_.])([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:%|percent\b|per\s+cent\b)", lambda n: F.concat(F.lit(" pct"), digits(n), F.lit(" ")))
    plain = F.regexp_replace(F.lower(raw), r"[^\p{L}\p{M}\p{N}_\s]", " ")
    tokens = F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), " ")
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS)))


def sentences(text: Column) -> Column:
    """Pieces between runs of ``. ! ?`` and line ends, trimmed, without empty ones."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")))
    return F.filter(pieces, lambda s: s != "")


def spoken_sentences(text: Column, least: int = 12) -> Column:
    """Sentences with their marks, split after ``. ! ?`` and white space; only those longer than ``least``."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])[\x20\x09-\x0D]+"), lambda s: F.length(s) > least)


def plain_numbers(text: Column) -> Column:
    """Distinct numbers as written, without commas."""
    return F.array_distinct(F.transform(all_matches(text, r"[0-9]+(?:[,0-9]*)(?:\.[0-9]+)?"), lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"\.$", "")))


def years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(all_matches(text, r"\b((?:19|20)[0-9]{2})\b", 1)))


def durations(text: Column) -> Column:
    """Distinct counts with years, months, days or weeks, such as ``7 years``."""
    found = all_matches(F.lower(text), r"\b([0-9]+[\x20\x09-\x0D]+(?:years?|months?|days?|weeks?))\b", 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[\x20\x09-\x0D]+", " "))))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(all_matches(text, r"\b([0-9]+(?:\.[0-9]+)?)\b", 1)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set's size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def substring_hits(tokens: Column, context: Column) -> Column:
    """Tokens that stand anywhere in the context, repeats included."""
    return F.filter(tokens, lambda t: F.contains(F.lower(context), t))


def overlap_percent(claim: Column, context: Column) -> Column:
    """Percentage of the claim's tokens that stand anywhere in the context."""
    tokens = F.transform(evidence_tokens(claim), lambda t: F.lower(t))
    return F.when((F.size(tokens) > 0) & (F.trim(context) != ""), 100.0 * F.size(substring_hits(tokens, context)) / F.size(tokens)).otherwise(F.lit(0.0))


def signed_numbers(text: Column) -> Column:
    return all_matches(text, r"-?[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?")


def boosted_overlap(claim: Column, context: Column) -> Column:
    """Percentage of the claim's core tokens in the context, with 20 for the whole phrase and 10 for a shared number, at most 100.

    Core tokens are digits or have more than three characters and are no stop
    words; a token also counts when it is there without a final M, B, K or %.
    """
    bare = lambda t: F.regexp_replace(t, "[MBKmbk%]+$", "")
    tokens = F.transform(evidence_tokens(claim), lambda t: F.lower(t))
    there = F.transform(evidence_tokens(context), lambda t: F.lower(t))
    core = F.array_distinct(F.filter(tokens, lambda t: (t.rlike("^[0-9]+$") | (F.length(t) > 3)) & ~t.isin(OVERLAP_STOPWORDS)))
    bare_there = F.array_distinct(F.transform(there, bare))
    hits = F.filter(core, lambda t: F.array_contains(there, t) | F.array_contains(bare_there, bare(t)))
    phrase = F.when(F.contains(F.array_join(there, " "), F.array_join(tokens, " ")), 20.0).otherwise(0.0)
    number = F.when(F.arrays_overlap(signed_numbers(claim), signed_numbers(context)), 10.0).otherwise(0.0)
    share = F.when(F.size(core) > 0, 100.0 * F.size(hits) / F.size(core)).otherwise(0.0)
    usable = (F.size(tokens) > 0) & (F.trim(context) != "")
    return F.when(usable, F.least(F.lit(100.0), share + phrase + number)).otherwise(F.lit(0.0))


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether the text holds any of the phrases."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


#: Words that choose what a claim is about.
DISTINGUISHING = (
    "flood fire water wind earthquake storm hail theft vandalism mold collapse flooding smoke explosion suffolk nassau county borough premises "
    "building deductible limit limits exclusion exclusions endorsement endorsements coverage excluded included replacement actual cash value "
    "insured mortgagee additional loss payee location property schedule"
).split()

#: Phrases that negate.
NEGATIONS = ["not ", "no ", "never ", "n't ", "cannot ", "doesn't ", "does not ", "won't ", "will not ", "isn't ", "is not ", "without "]


def weighted_match(claim: Column, excerpt: Column) -> Column:
    """Share of the claim's weight that the excerpt carries.

    Tokens longer than three characters weigh 1, distinguishing words and the
    claim's numbers 2. At most half counts where both state numbers and share
    none, or where only one of them negates.
    """
    tokens = F.transform(evidence_tokens(claim, 3), lambda t: F.lower(t))
    there = F.transform(all_matches(excerpt, "[A-Za-z0-9_%$.]+"), lambda t: F.lower(t))
    own, other = plain_numbers(claim), plain_numbers(excerpt)
    weight = lambda t: F.when(t.isin(DISTINGUISHING) | F.array_contains(own, t), 2.0).otherwise(1.0)
    total = F.aggregate(tokens, F.lit(0.0), lambda s, t: s + weight(t))
    matched = F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.when(F.array_contains(there, t), weight(t)).otherwise(0.0))
    apart = (F.size(own) > 0) & (F.size(other) > 0) & ~F.arrays_overlap(own, other)
    parity = any_of(F.lower(claim), NEGATIONS) != any_of(F.lower(excerpt), NEGATIONS)
    held = F.when(apart | parity, F.least(matched, total * 0.5)).otherwise(matched)
    return F.when(total > 0, held / total).otherwise(F.lit(0.0))


#: Pairs of opposites.
ANTONYMS = [
    ("increase", "decrease"), ("increase", "decline"), ("increase", "fall"), ("increase", "fell"), ("increased", "decreased"),
    ("increased", "declined"), ("increased", "fell"), ("increasing", "decreasing"), ("increasing", "declining"),
    ("increasing", "falling"), ("growth", "decline"), ("growth", "decrease"), ("profit", "loss"), ("gain", "loss"),
    ("increase", "reduce"), ("increased", "reduced"), ("rise", "fall"), ("up", "down"), ("higher", "lower"), ("exceed", "below"),
    ("above", "below"), ("profit", "deficit"), ("surplus", "deficit"), ("approve", "reject"), ("accept", "reject"), ("yes", "no"),
    ("true", "false"), ("include", "exclude"), ("includes", "excludes"), ("included", "excluded"), ("including", "excluding"),
    ("cover", "exclude"), ("covers", "excludes"), ("covered", "excluded"), ("coverage", "exclusion"), ("affirm", "deny"),
    ("affirmed", "denied"), ("grant", "deny"), ("granted", "denied"), ("permit", "prohibit"), ("permitted", "prohibited"),
    ("allow", "disallow"), ("allowed", "disallowed"), ("applicable", "inapplicable"), ("eligible", "ineligible"),
    ("valid", "invalid"), ("within", "outside"), ("mandatory", "optional"), ("admitted", "denied"),
]

#: Negations that opposition looks at, in order; the last decides what is taken out of the claim.
OPPOSING_NEGATIONS = NEGATIONS[:9]

#: Phrases that contradict.
CONTRADICTIONS = ["contrary to", "opposite of", "contradicts", "refutes", "disproves", "opposite is true", "wrong", "incorrect", "not the case", "false", "inaccurate", "mistaken"]


def opposes(claim: Column, excerpt: Column) -> Column:
    """Whether the excerpt says the opposite: by negation, opposites, other numbers or a contradicting phrase."""
    c, e = F.lower(claim), F.lower(excerpt)
    blank = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 3)
    positive = F.replace(c, F.lit(OPPOSING_NEGATIONS[-1]), F.lit(""))
    by_negation = (any_of(c, OPPOSING_NEGATIONS) != any_of(e, OPPOSING_NEGATIONS)) & F.exists(blank(positive), lambda w: F.contains(e, w))
    token = "[A-Za-z0-9_%$.]+"
    own, other = all_matches(c, token), all_matches(e, token)
    pairs = reduce(lambda a, b: a | b, [(F.array_contains(own, x) & F.array_contains(other, y)) | (F.array_contains(own, y) & F.array_contains(other, x)) for x, y in ANTONYMS])
    n, m = plain_numbers(claim), plain_numbers(excerpt)
    by_number = (F.size(n) > 0) & (F.size(m) > 0) & ~F.arrays_overlap(n, m)
    by_phrase = any_of(e, CONTRADICTIONS) & F.exists(blank(e), lambda w: F.contains(c, w))
    return by_negation | pairs | by_number | by_phrase


#: Patterns that make a source untrusted.
INSTRUCTIONS = [
    "ignore previous instructions",
    "do not disclose",
    "you are now",
    "act as",
    "pretend to be",
    "system prompt",
    "ignore.*instruction",
    "disregard.*instruction",
    "forget.*instruction",
    "override.*instruction",
]


def trust(text: Column) -> Column:
    """untrusted for texts that hold orders to the reader."""
    return F.when(F.lower(text).rlike("|".join(INSTRUCTIONS)), "untrusted").otherwise("trusted")


def slug(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def around(text: Column, term: Column, reach: int) -> Column:
    """The text around the first place of a term, ``reach`` characters on both sides; null without one."""
    at = F.instr(text, term)
    first = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, text.substr(first, at + F.length(term) + reach - first))
