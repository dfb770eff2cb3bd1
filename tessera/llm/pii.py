"""Personal data by weak supervision.

Four base kinds are found by their patterns. Further kinds, whose patterns
alone prove little, are candidates only: labelers of three sorts vote on each
candidate (its shape, gazetteers, the words before it), expectation
maximisation estimates how reliable each labeler is from how they agree, and
a logistic span classifier trained on the resulting soft labels decides. The
base kinds' matches, passing and failing, take part in the estimate.

Everything by document runs in Spark expressions. What reaches the driver is
the number of candidates of each combination of kind, votes and length class,
a table whose size the code below bounds, whatever the corpus.

Patterns use possessive quantifiers and look behind, so that a long run of
matching characters is scanned once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, stored, whole

CONTEXT = 40
#: Matches whose places are summed up at once.
PIECE = 256
LEAST_PROBABILITY = 0.8
EM_ROUNDS = 50
FIT_ROUNDS = 400

#: kind: pattern, and a cheap test that any text with a match passes.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"(?:[0-9][ -]?){15}[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
EXTRA = {
    "phone_local": (r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[.-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    "person": (r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? "),
    "email_hidden": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
        r"[\[(]at[\])]",
    ),
    # Keys, tokens and passwords: long runs of both letters and digits.
    "secret": (r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+=*+(?![.@])", "[A-Za-z0-9+/_-]{16}"),
}
KINDS = [*BASE, *EXTRA]

#: Common given names and top-level domains; callers may pass names of their own.
GIVEN_NAMES = (
    "adam agnes ahmed alan albert alexander alice amelia ana andrea andrew angela anna anne antonio arthur barbara ben benjamin bernard "
    "brian camille carla carlos caroline catherine charles charlotte chiara christian christine claire clara daniel david diana diego "
    "dominique edward elena elisabeth elizabeth ella emily emma enrique eric erik eva fatima felix fernando francesca francois frank "
    "frederic gabriel george giulia hannah hans heinrich helen helena henri henry hugo ines ingrid irene isabel jack jacques james jan "
    "jane javier jean jennifer jessica joan johann john jonas jorge jose joseph juan julia julie karin karl kate katharina kevin klaus "
    "laura leo linda lisa louis louise lucas lucia luis luisa lukas manuel marco margaret maria marie marion mark markus marta martin "
    "mary matthew max michael miguel mohammed monika nadia nicolas nina olivia oscar pablo patricia patrick paul peter petra philip "
    "pierre rachel richard robert rosa ruth samuel sandra sara sarah sebastian simon sofia sophie stefan stephen susan teresa thomas "
    "ursula victor victoria werner william wolfgang yusuf"
).split()
IBAN_COUNTRIES = "AD AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
TOP_DOMAINS = (
    "ae app ar at au be biz br ca cat ch cl cn co com cz de dev dk edu ee es eu fi fr gov gr hk hr hu id ie il in info int io ir is it jp ke "
    "kr lt lu lv me mil mx my name net ng nl no nz online org pe ph pk pl pro pt ro rs ru sa se sg si site sk store tech th tr tv tw ua uk us "
    "uy ve vn xyz za"
).split()
SECRET_PREFIXES = "^(?:sk|pk|rk)[-_]|^gh[opsu]_|^github_pat_|^glpat-|^xox[abps]-|^AKIA|^ASIA|^AIza|^eyJ"
#: Words that speak for a kind or against it when they stand shortly before.
FOR = {
    "email": "mail contact write",
    "ip": "ip address host server",
    "card": "card visa credit payment",
    "phone": "phone tel call fax mobile",
    "phone_local": "phone tel call fax mobile",
    "ssn": "ssn social security",
    "iban": "iban account bank konto",
    "person": "name contact signed patient dear",
    "email_hidden": "mail contact write",
    "secret": "token secret key password passwd pwd credential bearer",
}
AGAINST = "version isbn invoice figure section chapter model article page"

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def spans(text: Column, pattern: str, present: str) -> Column:
    """The non-overlapping matches of ``pattern`` from the left: start, end (exclusive, code points), the end of the text between it and the match before, match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(gaps, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), F.right(gap, F.lit(CONTEXT)).alias("before"), match.alias("match")))
    kind = "array<struct<start:int,end:int,before:string,match:string>>"
    none = F.array().cast(kind)

    def step(so_far: Column, x: Column) -> Column:
        begin = so_far["at"] + x["gap"]
        found = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), x["before"].alias("before"), x["match"].alias("match"))
        return F.struct((begin + x["size"]).alias("at"), F.array_append(so_far["out"], found).alias("out"))

    # A fold copies what it has gathered at each step, so places are summed up within pieces of the list, and the pieces' lengths over the list.
    def whole_list(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda so_far, p: F.array_append(so_far, F.element_at(so_far, -1) + p["at"]))
        moved = F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), lambda p, base: F.transform(p["out"], lambda x: F.struct((x["start"] + base).alias("start"), (x["end"] + base).alias("end"), x["before"].alias("before"), x["match"].alias("match"))))
        return F.flatten(moved)

    def summed(all_steps: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / PIECE).cast("int")), lambda n: F.slice(all_steps, n * PIECE + 1, F.lit(PIECE)))
        parts = F.transform(pieces, lambda piece: F.aggregate(piece, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        return F.get(F.transform(F.array(parts), whole_list), F.lit(0))

    found = F.get(F.transform(F.array(steps), lambda all_steps: F.when(F.size(all_steps) > 0, summed(all_steps)).otherwise(none)), F.lit(0))
    return F.when(text.rlike(present), found).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def base_valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _one_of(value: Column, known: list[str]) -> Column:
    return value.isin(known)


def _shape(kind: str, match: Column) -> Column:
    """Vote of the shape labeler: 1 for, -1 against, 0 neither."""
    if kind in BASE:
        good = base_valid(kind, match)
    elif kind == "phone_local":
        good = _digits(match).rlike("^[2-9][0-9]{2}[2-9]")
    elif kind == "ssn":
        good = ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    elif kind == "iban":
        good = F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34)
    elif kind == "person":
        return F.when(match.rlike(r"\p{Ll} \p{Lu}\p{Ll}+$"), 1).otherwise(0)
    elif kind == "secret":
        # As many digits as random letters and digits have, or a digest's length of hexadecimal digits.
        share = F.length(_digits(match)) / F.length(match)
        good = share.between(0.08, 0.9) & (F.length(match) >= 20) & ~match.rlike("^[0-9+-]+$") & (match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | match.rlike("[A-Z].*[0-9].*[a-z]|[0-9].*[A-Za-z].*[0-9].*[A-Za-z]"))
    else:
        good = match.rlike("[A-Za-z]{2,6}$")
    return F.when(good, 1).otherwise(-1)


def _gazetteer(kind: str, match: Column, names: list[str]) -> Column:
    if kind == "secret":
        return F.when(match.rlike(SECRET_PREFIXES), 1).otherwise(0)
    if kind == "iban":
        return F.when(_one_of(F.substring(match, 1, 2), IBAN_COUNTRIES), 1).otherwise(-1)
    if kind == "person":
        return F.when(_one_of(F.lower(F.regexp_extract(match, r" (\p{L}+)", 1)), names), 1).otherwise(0)
    if kind in ("email", "email_hidden"):
        return F.when(_one_of(F.lower(F.regexp_extract(match, "[A-Za-z]+$", 0)), TOP_DOMAINS), 1).otherwise(0)
    return F.lit(0)


def _words(words: str) -> str:
    return rf"(?i)\b(?:{'|'.join(words.split())})"


def _candidates(text: Column, kind: str, names: list[str]) -> Column:
    """Matches of a kind with the labelers' votes, a class of length and one of content (letters, digits, both)."""
    pattern, present = (BASE | EXTRA)[kind]

    def vote(s: Column) -> Column:
        before = s["before"]
        context = F.when(before.rlike(_words(FOR[kind])), 1).otherwise(0)
        against = F.when(before.rlike(_words(AGAINST)), -1).otherwise(0)
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            _shape(kind, s["match"]).alias("shape"),
            _gazetteer(kind, s["match"], names).alias("gazetteer"),
            context.alias("context"),
            against.alias("against"),
            F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(4)).cast("int").alias("length"),
            F.when(~s["match"].rlike("[0-9]"), 0).when(~s["match"].rlike(r"\p{L}"), 1).otherwise(2).alias("mix"),
        )

    return F.transform(spans(text, pattern, present), vote)


LABELERS = ("shape", "gazetteer", "context", "against")


def reliabilities(rows: list[dict]) -> tuple[list[float], list[float]]:
    """Each labeler's chance to be right when it votes, and each row's chance to be personal data.

    rows: votes by LABELERS and ``n``, how many candidates voted so. Reliabilities
    stay between 0.55 and 0.95: labelers are better than chance by design, and
    few candidates prove none perfect.
    """
    right, prior = [0.75] * len(LABELERS), 0.5
    chance = [0.5] * len(rows)
    for _ in range(EM_ROUNDS):
        for i, row in enumerate(rows):
            odds = math.log(prior / (1 - prior)) + sum(row[name] * math.log(r / (1 - r)) for name, r in zip(LABELERS, right, strict=True))
            chance[i] = 1 / (1 + math.exp(-odds))
        total = sum(row["n"] for row in rows)
        prior = min(0.95, max(0.05, (1 + sum(c * row["n"] for c, row in zip(chance, rows, strict=True))) / (2 + total)))
        for j, name in enumerate(LABELERS):
            agree, votes = 7.5, 10.0
            for c, row in zip(chance, rows, strict=True):
                if row[name]:
                    agree += row["n"] * (c if row[name] > 0 else 1 - c)
                    votes += row["n"]
            right[j] = min(0.95, max(0.55, agree / votes))
    return right, chance


def _features(row: dict) -> dict[str, float]:
    votes = {name: float(row[name]) for name in LABELERS}
    return {"always": 1.0, f"kind {row['kind']}": 1.0, f"length {row['length']}": 1.0, f"mix {row.get('mix', 0)}": 1.0, **votes}


def fit_classifier(rows: list[dict], chance: list[float]) -> dict[str, float]:
    """Weights of a logistic classifier of the soft labels, by gradient steps with a ridge of 0.01."""
    weights: dict[str, float] = {name: 0.0 for row in rows for name in _features(row)}
    weights |= {"always": 0.0} | {name: 0.0 for name in LABELERS}
    # Square roots keep one frequent combination from settling everything.
    mass = [math.sqrt(row["n"]) for row in rows]
    total = sum(mass) or 1.0
    for _ in range(FIT_ROUNDS):
        slope = {name: 0.01 * w for name, w in weights.items()}
        for row, c, m in zip(rows, chance, mass, strict=True):
            own = _features(row)
            p = 1 / (1 + math.exp(-sum(weights[f] * v for f, v in own.items())))
            for f, v in own.items():
                slope[f] += m / total * (p - c) * v
        for name in weights:
            weights[name] -= 1.0 * slope[name]
    return weights


def _score(weights: dict[str, float], s: Column) -> Column:
    """The classifier's log odds as an expression."""
    terms = [F.lit(weights["always"])] + [F.lit(weights[name]) * s[name] for name in LABELERS]
    for name, field in (("kind", "kind"), ("length", "length"), ("mix", "mix")):
        cases = [(k.partition(" ")[2], w) for k, w in sorted(weights.items()) if k.startswith(f"{name} ")]
        if cases:
            chosen = F.when(s[field].cast("string") == cases[0][0], cases[0][1])
            for value, w in cases[1:]:
                chosen = chosen.when(s[field].cast("string") == value, w)
            terms.append(chosen.otherwise(F.lit(0.0)))
    return reduce(lambda a, b: a + b, terms)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: list[str] = GIVEN_NAMES) -> DataFrame:
    """One row per row of ``docs``: id, base and added, arrays of kind, start and end in order of kind and start.

    A null text counts as empty. Base spans are the valid matches of the four
    base kinds. Added spans are candidates of the other kinds that the
    classifier accepts and that overlap no base span. A text of any length is
    searched whole, in time linear in its length. Null ids and repeated rows
    are returned as they come; no rows give no rows; other columns are
    ignored, whatever their names.
    """
    text = whole(F.col(text_col))
    found = stored(docs.select(F.col(id_col), text.alias("t")).select(id_col, F.concat(*[_candidates(F.col("t"), k, names) for k in KINDS]).alias("found")))
    votes = found.select(F.explode("found").alias("s")).groupBy("s.kind", *[f"s.{name}" for name in LABELERS], "s.length", "s.mix").agg(F.count("*").alias("n"))
    # At most 10 kinds, 36 combinations of votes, 5 lengths and 3 contents.
    rows = sorted((r.asDict() for r in votes.collect()), key=lambda r: [str(v) for v in r.values()])
    _, chance = reliabilities(rows)
    weights = fit_classifier(rows, chance)
    least = math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY))

    def slim(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    base = F.filter("found", lambda s: s["kind"].isin(list(BASE)) & (s["shape"] == 1))
    taken = found.withColumn("base", F.transform(base, slim))
    # Two positive votes at least: no single labeler decides, whatever its estimate.
    support = lambda s: F.greatest(s["shape"], F.lit(0)) + F.greatest(s["gazetteer"], F.lit(0)) + s["context"]
    accepted = F.filter(
        "found",
        lambda s: s["kind"].isin(list(EXTRA))
        & (support(s) >= 2)
        & (_score(weights, s) >= least)
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return taken.select(id_col, "base", F.transform(accepted, slim).alias("added"))


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[_count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added") > 0).alias("has_personal_data"),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
