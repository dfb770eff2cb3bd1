"""Sentences that order their reader, told by their structure: who acts, who is addressed, what is pointed at, how it opens.

All patterns are of Unicode classes, and Column functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import any_of

#: Phrases that order the reader, in the order in which they are reported.
PHRASES = ["ignore previous", "ignore all previous", "disregard the above", "new instructions", "system:", "assistant:", "begin your response with", "output only"]
#: Further forms, each under the name of the phrase that it stands for.
PHRASE_FORMS = [
    ("begin your response with", r"begin\s+(?:your|every|each|all|the)\s+response\s+with"),
    ("you must", r"\b(?:you|assistant|the model|the system)\s+must\s+(?:ignore|disregard|forget|override|obey|output|respond|reply|answer|print|reveal|repeat|not\s+(?:mention|say|include))\b"),
]

#: Who a text is addressed to, and how it says what they are to do.
SECOND_PERSON = "you thou your yours yourself yourselves".split()
READERS = "reader readers model assistant chatbot llm ai".split()
DUTIES = ["must", "shall", "should", "need", "needs", r"have\s+to", r"has\s+to", r"are\s+to", r"is\s+to", r"are\s+required", r"is\s+required", r"must\s+not", r"shall\s+not", r"should\s+not", r"do\s+not", r"does\s+not"]
DELIVERABLES = "answer response reply output outputs memo summary draft report".split()
LABELS = ["attention", "reminder", "instructions?", "directive"]

#: Words that point at the text itself.
NEARBY = ["above", "below", "preceding", "foregoing"]
BEFORE = "previous prior earlier preceding above".split()
PASSAGES = "instruction instructions text message prompt prompts paragraph paragraphs sentence sentences material materials source sources words".split()
POINTERS = [r"these\s+instructions", r"the\s+instructions", r"the\s+prompt", r"the\s+system\s+prompt", r"the\s+source\s+material", r"the\s+(?:provided|uploaded|attached)\s+(?:source|material|document|file)"]

#: Words that open a clause without being its verb.
FUNCTION_WORDS = (
    "the a an this that these those it its he she him her they them their we us our i my me you your each every all some any no none both either neither such "
    "which who whom whose what in of to for with on at by from as under over after before during upon without within notwithstanding per regarding concerning "
    "subject pursuant if when where whereas unless except provided whether because since although though and or but nor so yet however therefore thus hence hereby "
    "herein hereinafter hereto thereof thereto therein also then additionally further furthermore moreover namely including excluding please"
).split()
HEADING_NOUNS = (
    "page section item clause clauses schedule exhibit attachment endorsement form forms table paragraph sentence line column appendix addendum declaration "
    "declarations notice part parts article"
).split()
NOUN_ENDINGS = ["tion", "sion", "ments?", "ance", "ence", "ness", "ity"]
DETERMINERS = "the a an this that these those all any each every your its their our my his her".split()


def _one(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


_READER = rf"the\s+{_one(READERS)}"
_ADDRESSED = [rf"note\s+to\s+{_READER}", rf"to\s+{_READER}", r"dear\s+\w+", *LABELS, rf"(?:the\s+)?{_one(READERS)}"]
#: A word where a verb stands: no function word, heading noun, nominalisation, participle or plural.
_VERB_PLACE = rf"(?!(?i:{_one(FUNCTION_WORDS)})\b)(?!(?i:{_one(HEADING_NOUNS)})\b)(?!(?i:\w+{_one(NOUN_ENDINGS)}\b))(?!(?i:\w+(?:ing|ed)\b))(?!(?i:[a-z]{{2,}}(?<![sui])s\b))"

_READER_ACTS = rf"(?:{_one(SECOND_PERSON)}|{_READER})\s+{_one(DUTIES)}"
_DELIVERABLE = rf"your\s+{_one(DELIVERABLES)}"
_POINTING = rf"the\s+{_one(NEARBY)}|(?:the|these|those|all)\s+{_one(BEFORE)}\s+{_one(PASSAGES)}|{_one(POINTERS)}"


def _anywhere(letters: str, *patterns: str) -> str:
    """Any of ``patterns`` between words. The letters that they begin with, to which no others fold, are looked for before Unicode's word boundary."""
    return rf"(?=[{letters.upper()}{letters}])(?i)\b{_one(list(patterns))}\b"


#: What is quick to tell is sought first and changes no answer: the mark that an address ends on, an imperative's object.
_PATTERNS = {
    "addressed": rf"^(?=[^:,!]*[:,!])(?i)\W*(?:\w+[\s-]+){{0,2}}{_one(_ADDRESSED)}\s*[:,!]",
    "reader_acts": _anywhere("yt", _READER_ACTS),
    "deliverable": _anywhere("y", _DELIVERABLE),
    "pointing": _anywhere("ta", _POINTING),
    "verb_opens": rf"^\W*{_VERB_PLACE}[A-Za-z][\w'-]*",
    "listed": r"(?i)^\W*[A-Za-z][\w'-]*\s+(?:and|or|nor|but)\b",
    "imperative": rf"^\W*(?=(?:[A-Z][a-z][\w'-]*+|[A-Z]{{2,}})\s+(?i:{_one(DETERMINERS)})\b){_VERB_PLACE}",
    "may_order": _anywhere("yta", _READER_ACTS, _DELIVERABLE, _POINTING),
}
#: What ``str.strip`` and ``\s`` mean in every script.
_BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(text: Column) -> Column:
    # Looked for only where one of the ends is blank: the pattern is tried at every place of the text.
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(_BLANK), F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+\z", "")).otherwise(text)


def collapsed(text: Column) -> Column:
    """The text without white space at its ends, and each run of it inside as one space."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), f"{_BLANK}+", " "))


def flagged_phrases(text: Column) -> Column:
    """The phrases that order the reader, in their order, then further forms whose phrase isn't among them."""
    lowered = F.lower(text)
    hits = F.filter(F.array(*[F.lit(p) for p in PHRASES]), lambda p: F.contains(lowered, p))
    for name, pattern in PHRASE_FORMS:
        hits = F.when(~F.array_contains(hits, name) & text.rlike(f"(?iU){pattern}"), F.array_append(hits, F.lit(name))).otherwise(hits)
    return hits


def order_flags(sentence: Column) -> dict[str, Column]:
    """Five tests of a sentence's structure, any of which makes it an order: address at the head, the reader under a duty,
    the reader's own deliverable, a verb that opens and points at the text, the shape of an imperative with its object."""
    return stripped_order_flags(stripped(sentence))


def _has(s: Column, name: str) -> Column:
    return s.rlike(f"(?U){_PATTERNS[name]}")


def stripped_order_flags(s: Column) -> dict[str, Column]:
    """:func:`order_flags` of what is stripped already. As each test strips its sentence anew, a table of sentences is better stripped first."""
    return {
        "addressed": _has(s, "addressed"),
        "reader_acts": _has(s, "reader_acts"),
        "deliverable": _has(s, "deliverable"),
        "pointing": _has(s, "pointing") & _has(s, "verb_opens") & ~_has(s, "listed"),
        "imperative": _has(s, "imperative"),
    }


def may_order(s: Column) -> Column:
    """Whether a stripped sentence can meet any of :func:`order_flags`: those that stand anywhere in it are sought in one pass."""
    return _has(s, "addressed") | _has(s, "imperative") | _has(s, "may_order")


def orders_reader(sentence: Column) -> Column:
    """Whether any of :func:`order_flags` holds; false for a blank sentence."""
    flags = list(order_flags(sentence).values())
    found = flags[0]
    for flag in flags[1:]:
        found = found | flag
    return F.coalesce(found, F.lit(False))


def may_be_evidence(sentence: Column) -> Column:
    """Whether a source's sentence can carry a claim: it neither orders its reader nor holds a flagged phrase."""
    forms = [sentence.rlike(f"(?iU){pattern}") for _, pattern in PHRASE_FORMS]
    return ~(orders_reader(sentence) | any_of(F.lower(sentence), PHRASES) | forms[0] | forms[1])
