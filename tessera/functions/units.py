"""Texts as units of evidence: sentences with pages, short ones joined, their content tokens and quantities.

What a number means depends on the words before it, and which sentences are
joined on those joined before, so texts are read from start to end, once, in
Arrow batches. Each step looks at a bounded piece of what it has read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.text import STOPWORDS

#: Patterns of pages, sentence ends, amounts and percentages.
_PAGE = re.compile(r"--- Page (\d+) ---")
_SENTENCE_END = re.compile(r"[.!?\n]+")
_MONEY = re.compile(r"\$\s*(\d[\d,]*(?:\.\d+)?)")
_PERCENT = re.compile(r"(?<![\w.])(\d[\d,]*(?:\.\d+)?)\s*(?:%|percent\b|per\s+cent\b)", re.I)
_WORD = re.compile(r"\w{3,}")

#: Patterns of numbers, and of what makes one a reference.
_NUMBER = re.compile(r"\d+(?:,\d+)*(?:\.\d+)?")
_KEYWORD = re.compile(r"(?:\b(?:Sections?|Articles?|Clauses?|Exhibits?|Appendi(?:x|ces)|Schedules?|Paragraphs?|Pages?|Nos?)\.?|§)", re.I)
_LIST_ITEM = re.compile(r"\d+(?:,\d+)*(?:\.\d+)?|and|or|to|through|thru|&|,|;|–|—|-", re.I)
_BLANKS = re.compile(r"[ \t]*")
_IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+){2,}")
_LIST_MARK = re.compile(r"^[ \t]*(\d+)[.)][ \t\n]", re.M)

_STOP = frozenset(STOPWORDS)
#: A sentence or a run of them with fewer tokens is joined to the next one.
LEAST_TOKENS = 4


def _money_token(match: re.Match) -> str:
    amount = float(match[1].replace(",", ""))
    return f" money{int(amount)} " if amount.is_integer() else f" money{amount} "


def content_tokens(text: str) -> set[str]:
    """Words of more than two characters that aren't stop words; money and percentages are one token each."""
    plain = _MONEY.sub(_money_token, text) if "$" in text else text
    lowered = plain.lower()
    # Looked for only where a percentage may be: the pattern is tried at every place of the text.
    if "%" in lowered or "cent" in lowered:
        lowered = _PERCENT.sub(lambda m: " pct" + m[1].replace(",", "") + " ", plain).lower()
    return set(_WORD.findall(lowered)) - _STOP


class _References:
    """Follows the list behind the last keyword: which places it reaches through numbers, joining words and blanks."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ahead = _KEYWORD.finditer(text)
        self.next = next(self.ahead, None)
        self.reach: int | None = None

    def holds(self, start: int) -> bool:
        while self.next is not None and self.next.end() <= start:
            self.reach = self.next.end()
            self.next = next(self.ahead, None)
        while self.reach is not None and self.reach < start:
            self.reach = _BLANKS.match(self.text, self.reach).end()
            if self.reach < start:
                item = _LIST_ITEM.match(self.text, self.reach)
                self.reach = item.end() if item else None
        return self.reach is not None


def quantities(text: str) -> set[str]:
    """The numbers that state a quantity, in one form: 5,000,000 and 5000000.0 are 5000000.

    Left out are numbers behind a keyword of reference (Section 3, Pages 5 and
    6), inside an identifier of three parts or more joined by hyphens, and at
    the head of a line as a mark of a list. Linear in the text: keywords,
    identifiers and marks are read along with the numbers.
    """
    if not _NUMBER.search(text):
        return set()
    references = _References(text)
    marks = {m.start(1) for m in _LIST_MARK.finditer(text)}
    identifiers = _IDENTIFIER.finditer(text)
    identifier = next(identifiers, None)
    found = set()
    for match in _NUMBER.finditer(text):
        start, end = match.span()
        while identifier is not None and identifier.end() < end:
            identifier = next(identifiers, None)
        inside = identifier is not None and identifier.start() <= start
        marked = start in marks and text[end : end + 1] in (".", ")")
        # Asked for every number, as the list goes on through those that don't count.
        if not references.holds(start) and not inside and not marked:
            found.add(f"{float(match[0].replace(',', '')):.6f}".rstrip("0").rstrip("."))
    return found


def paged_sentences(text: str) -> Iterator[tuple[str, int | None]]:
    """Sentences, trimmed, each with the page whose mark was last seen."""
    pieces = _PAGE.split(text)
    for place in range(0, len(pieces), 2):
        page = int(pieces[place - 1]) if place else None
        for part in _SENTENCE_END.split(pieces[place]):
            if part := part.strip():
                yield part, page


def _may_react(before: str, part: str) -> bool:
    """Whether tokens may change where the two texts meet, as an amount or a percentage does that is spread over both."""
    return before.endswith("$") or part.startswith("%") or part[:4].lower() == "cent" or part[:3].lower() == "per"


def merged_sentences(sentences: Iterator[tuple[str, int | None]]) -> Iterator[tuple[str, int | None, set[str]]]:
    """Sentences of ``LEAST_TOKENS`` tokens or more; shorter ones are joined to what follows until they have as many, with the first page known.

    What is left at the end comes as it is. Tokens of a run are those of its
    sentences; only where an amount may be spread over two is the run read again.
    """
    parts: list[str] = []
    tokens: set[str] = set()
    page = None
    for part, at in sentences:
        again = bool(parts) and _may_react(parts[-1], part)
        parts.append(part)
        page = at if page is None else page
        tokens = content_tokens(" ".join(parts)) if again else tokens | content_tokens(part)
        if len(tokens) >= LEAST_TOKENS:
            yield " ".join(parts), page, tokens
            parts, tokens, page = [], set(), None
    if parts:
        yield " ".join(parts), page, tokens


Unit = tuple[str, int | None, set[str], set[str]]


def evidence_units(text: str) -> list[Unit]:
    """A source's units that can be evidence: sentence, page, tokens and quantities."""
    return [(sentence, page, tokens, quantities(sentence)) for sentence, page, tokens in merged_sentences(paged_sentences(text)) if len(tokens) >= LEAST_TOKENS]


def whole_unit(text: str) -> list[Unit]:
    """A text as one unit, as claims are; none if it is blank."""
    return [(text.strip(), None, content_tokens(text.strip()), quantities(text.strip()))] if text.strip() else []


#: The sentences, words and numbers of ``functions/text.py`` in ASCII.
_PLAIN_END = re.compile(r"[.!?\n]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]{3,}")
_PLAIN_NUMBER = re.compile(r"[0-9]+[,0-9]*(?:\.[0-9]+)?")


def plain_units(text: str) -> list[Unit]:
    """A source's sentences with ``LEAST_TOKENS`` content words or more, with the words and numbers that the SQL of anchors finds."""
    found = []
    for part in _PLAIN_END.split(text):
        words = set(_PLAIN_WORD.findall(part.lower())) - _STOP
        if len(words) >= LEAST_TOKENS:
            found.append((part.strip(" \t\n\x0b\x0c\r"), None, words, {n.replace(",", "") for n in _PLAIN_NUMBER.findall(part)}))
    return found


UNITS = "array<struct<sentence string, page long, words array<string>, numbers array<string>>>"
_LISTED = pa.list_(pa.string())


#: So many characters of texts are read before their units are passed on.
PIECE_CHARS = 1_000_000


def pieces(batch: pa.RecordBatch, sizes: Iterable[int], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose sizes add up to ``most`` or little more."""
    start = held = 0
    for row, size in enumerate(sizes, 1):
        held += size or 0
        if held >= most:
            yield batch.slice(start, row - start)
            start, held = row, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def units_of(read: Callable[[str], list[Unit]], rank: Callable[[set[str]], list[str]] = sorted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows (key, text) as (key, units), words in the order that ``rank`` gives; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, pc.utf8_length(whole.column(1)).to_pylist(), PIECE_CHARS)):
            counts, flat = [0], []
            for text in batch.column(1):
                flat += read(text.as_py() or "")
                counts.append(len(flat))
            columns = [
                pa.array([u[0] for u in flat], pa.string()),
                pa.array([u[1] for u in flat], pa.int64()),
                pa.array([rank(u[2]) for u in flat], _LISTED),
                pa.array([sorted(u[3]) for u in flat], _LISTED),
            ]
            units = pa.StructArray.from_arrays(columns, names=["sentence", "page", "words", "numbers"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), units)], names=["key", "units"])

    return run
