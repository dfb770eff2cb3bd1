"""What is asked for and how: shapes of answers, routes, trimmed context, ranges and magnitudes, translated claims, evaluation cases, chosen variations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.functions import text as X
from tessera.functions.orders import stripped
from tessera.plans.draft_gate import QUESTION_WORDS
from tessera.plans.ledger import RELATIONS
from tessera.plans.text_queries import INTENTS, classify_intent, _intent_sql
from tessera.registry import query
from tessera.sources.tables import table

#: Words of an ask that wants a document, and first words of a question beyond the gate's.
MEMO_CUES = (
    "draft write summarize summarise summary compose narrative report memo memorandum brief briefing overview update outline proposal plan analysis "
    "analyze analyse assess assessment dossier deliverable rewrite expand elaborate"
).split()
FIRST_WORDS = [*QUESTION_WORDS, "whom", "has", "have"]


def choose_shape(ask: Column) -> Column:
    """``direct`` for a question or an ask to extract, ``memo`` for an ask that wants a document, and for none."""
    plain = stripped(F.coalesce(ask, F.lit("")))
    words = F.regexp_extract_all(F.lower(plain), F.lit("[a-z]+"), F.lit(0))
    memo = F.arrays_overlap(words, F.array(*[F.lit(w) for w in MEMO_CUES]))
    asks = F.endswith(plain, F.lit("?")) | F.coalesce(F.get(words, F.lit(0)).isin(FIRST_WORDS), F.lit(False))
    return F.when((plain == "") | memo, "memo").when((classify_intent(plain, INTENTS) == "extract") | asks, "direct").otherwise("memo")


def route(ask: Column, has_sources: Column) -> Column:
    """task, has_sources and intent of an ask; a task that isn't known is a draft."""
    intent = classify_intent(stripped(F.coalesce(ask, F.lit(""))), INTENTS)
    return F.struct(F.when(intent == "unknown", "draft").otherwise(intent).alias("task"), F.coalesce(has_sources, F.lit(False)).alias("has_sources"), intent.alias("intent"))


_ASKS = "a AS (SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN 'Extract the list: ' || text WHEN 1 THEN trim(text) || ' Is it so?' WHEN 2 THEN 'Which ' || text ELSE 'Write a memo. ' || text END AS ask FROM conversations)"
_ASK_WORDS = "regexp_extract_all(lower(ask), '[a-z]+')"


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as asks of four kinds."""
    text, kind = F.col("text"), F.col("conv_id") % 4
    ask = F.when(kind == 0, F.concat(F.lit("Extract the list: "), text)).when(kind == 1, F.concat(F.trim(text), F.lit(" Is it so?"))).when(kind == 2, F.concat(F.lit("Which "), text)).otherwise(F.concat(F.lit("Write a memo. "), text))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", ask.alias("ask"))


@query(f"""
WITH {_ASKS}
SELECT conv_id, turn, CASE WHEN list_has_any({_ASK_WORDS}, [{sql.quoted(MEMO_CUES)}]) THEN 'memo' WHEN {_intent_sql("ask", INTENTS)} = 'extract' OR suffix(rtrim(ask), '?') OR list_contains([{sql.quoted(FIRST_WORDS)}], {_ASK_WORDS}[1]) THEN 'direct' ELSE 'memo' END AS shape FROM a
""")
def t14_answer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each ask wants an answer or a document."""
    return asks(spark, sf_dir).select("conv_id", "turn", choose_shape(F.col("ask")).alias("shape"))


@query(f"""
WITH {_ASKS}, i AS (SELECT conv_id, turn, {_intent_sql("ask", INTENTS)} AS intent, role = 'user' AS has_sources FROM a)
SELECT conv_id, turn, CASE WHEN intent = 'unknown' THEN 'draft' ELSE intent END AS task, has_sources, intent FROM i
""")
def t14_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each ask goes."""
    return asks(spark, sf_dir).select("conv_id", "turn", route(F.col("ask"), F.col("role") == "user").alias("r")).select("conv_id", "turn", "r.*")


def marked_sentences(text: Column) -> Column:
    """Sentences with their marks, split after ``. ! ?`` and white space, trimmed, none blank."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def trimmed(text: Column, head: int | None = None, tail: int | None = None) -> Column:
    """The first or the last so many sentences of a text, joined by blanks."""
    found = marked_sentences(text)
    if head is not None:
        found = F.slice(found, 1, head)
    if tail is not None:
        found = F.slice(found, F.greatest(F.size(found) - tail + 1, F.lit(1)), F.lit(tail))
    return F.array_join(found, " ")


def summary(text: Column, sentences: int = 2, chars: int = 240) -> Column:
    """A text's first sentences, or its first characters if it has none."""
    short = trimmed(text, head=sentences)
    return F.when(short != "", short).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, chars))


@query()
def t5_trimmed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the end of the one before it and a summary of the one behind it; SQL cannot split after a mark."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", "turn", "text", F.lag("text").over(order).alias("before"), F.lead("text").over(order).alias("after"))
    return rows.select("conv_id", "turn", trimmed(F.col("before"), tail=2).alias("before"), summary(F.col("after")).alias("after"), F.size(marked_sentences(F.col("text"))).alias("sentences"))


#: Patterns of a statement of two bounds, and the powers of ten that words of magnitude stand for.
RANGES = [r"\bbetween\s+\$?\d[\d,.]*\s+and\s+\$?\d", r"\$?\d[\d,.]*\s*(?:to|through|–|—|-)\s*\$?\d"]
SCALES = {"thousand": 3, "k": 3, "million": 6, "mn": 6, "m": 6, "billion": 9, "bn": 9, "b": 9, "trillion": 12, "tn": 12}
SCALED = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(thousand|million|billion|trillion|tn|bn|mn|k|m|b)\b"
STEPS = [0, 3, 6, 9, 12]


def states_a_range(text: Column) -> Column:
    """Whether a text compares two bounds and not one value."""
    return text.rlike(f"(?i){RANGES[0]}") | text.rlike(f"(?i){RANGES[1]}")


def scale_conflict(sentence: Column, value: Column) -> Column:
    """The figure of the sentence, with its word of magnitude, that the value repeats with another magnitude; null if none decides so.

    The first figure that equals the value, in its own or another magnitude,
    decides. Equal means within a relative 1e-9.
    """
    found = F.arrays_zip(*[X.all_matches(sentence, SCALED, g).alias(f"g{g}") for g in range(3)])
    power = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])

    def same(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))

    def read(m: Column) -> Column:
        base = F.replace(m["g1"], F.lit(","), F.lit("")).cast("double")
        exponent = power[F.lower(m["g2"])]
        own = same(value, base * F.pow(F.lit(10.0), exponent))
        other = F.exists(F.array(*[F.lit(s) for s in STEPS]), lambda s: (s != exponent) & same(value, base * F.pow(F.lit(10.0), s)))
        return F.struct(F.trim(m["g0"]).alias("phrase"), own.alias("own"), other.alias("other"))

    first = F.get(F.filter(F.transform(found, read), lambda r: r["own"] | r["other"]), F.lit(0))
    return F.when(~first["own"], first["phrase"])


@query(rf"""
SELECT doc_id, regexp_matches(text, '(?i){RANGES[0]}') OR regexp_matches(text, '(?i){RANGES[1]}') AS is_range FROM documents WHERE text IS NOT NULL
""")
def t21_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document states a range anywhere."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", states_a_range(F.col("text")).alias("is_range"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS q, (['thousand', 'million', 'bn', 'K'])[l_suppkey % 4 + 1] AS word, ([3, 6, 9, 3])[l_suppkey % 4 + 1] AS e, ([0, 3, 6, 9, 12, 7])[l_partkey % 6 + 1] AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s <> e AND s <> 7 THEN q || ' ' || word END AS conflict FROM p
""")
def t21_scale_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps stated with a word of magnitude against figures that lost it."""
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))
    word = pick(["thousand", "million", "bn", "K"], F.col("l_suppkey") % 4)
    quantity = F.col("l_quantity").cast("int")
    sentence = F.concat(F.lit("Subject to a cap of $"), quantity, F.lit(" "), word, F.lit(" at site 7."))
    value = quantity * F.pow(F.lit(10.0), pick([0, 3, 6, 9, 12, 7], F.col("l_partkey") % 6))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scale_conflict(sentence, value).alias("conflict"))


_CLAIM = "metric string, relation string, expected string, operands array<struct<name:string,value:string,unit:string,source_sentence:string>>"


def parsed_claim(answer: Column) -> Column:
    """The claim that a model's answer translates, or null: metric, operands, relation, expected.

    The object is what lies between the first and the last brace. A relation
    that isn't known, an expected value that is no number, an operand without a
    number or a name, and an answer with neither metric nor operands are no
    claim.
    """
    payload = F.from_json(F.nullif(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0), F.lit("")), _CLAIM)
    relation = F.lower(F.trim(payload["relation"]))
    number = lambda c: c.try_cast("double")
    good = F.forall(payload["operands"], lambda o: o.isNotNull() & number(o["value"]).isNotNull() & (F.coalesce(F.trim(o["name"]), F.lit("")) != ""))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    operands = F.transform(payload["operands"], lambda o: F.struct(F.trim(o["name"]).alias("name"), number(o["value"]).alias("value"), text(o["unit"]).alias("unit"), text(o["source_sentence"]).alias("source_sentence")))
    usable = relation.isin(*RELATIONS) & number(payload["expected"]).isNotNull() & payload["operands"].isNotNull() & good & ((text(payload["metric"]) != "") | (F.size(payload["operands"]) > 0))
    return F.when(usable, F.struct(text(payload["metric"]).alias("metric"), operands.alias("operands"), relation.alias("relation"), number(payload["expected"]).alias("expected")))


@query("""
WITH c AS (SELECT event_id, event_id % 9 AS kind, user_id, value, (['eq', 'lt', ' LE ', 'gt', 'ge', 'like'])[event_id % 6 + 1] AS relation FROM events)
SELECT event_id, CASE WHEN kind = 6 THEN '' ELSE 'user ' || user_id END AS metric, CASE WHEN kind = 5 THEN 0 ELSE 2 END AS operands, lower(trim(relation)) AS relation, value AS expected
FROM c WHERE relation <> 'like' AND kind NOT IN (0, 1, 2, 3, 7) AND value IS NOT NULL
""")
def v28_parsed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as translated claims in a model's words, some of them broken: bad operand, no name, no list, no number, no object."""
    kind = F.col("event_id") % 9
    relation = F.element_at(F.array(*[F.lit(r) for r in ("eq", "lt", " LE ", "gt", "ge", "like")]), (F.col("event_id") % 6 + 1).cast("int"))
    operand = lambda name, value: F.concat(F.lit('{"name": "'), name, F.lit('", "value": '), value, F.lit(', "unit": "USD"}'))
    second = F.when(kind == 0, operand(F.lit("b"), F.lit('"n/a"'))).when(kind == 1, operand(F.lit(" "), F.lit("1"))).otherwise(operand(F.lit("b"), F.lit('"2.5"')))
    operands = F.when(kind == 2, F.lit('"none"')).when(kind == 5, F.lit("[]")).otherwise(F.concat(F.lit("["), operand(F.lit("a"), F.lit("1")), F.lit(", "), second, F.lit("]")))
    metric = F.when(kind == 6, "").otherwise(F.concat(F.lit("user "), "user_id"))
    expected = F.when(kind == 3, F.lit('"many"')).otherwise(F.col("value").cast("string"))
    body = F.concat(F.lit('{"metric": "'), metric, F.lit('", "relation": "'), relation, F.lit('", "expected": '), expected, F.lit(', "operands": '), operands, F.lit("}"))
    answer = F.when(kind == 7, F.lit("no claim here")).when(kind == 8, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n``` as asked"))).otherwise(body)
    found = table(spark, sf_dir, "events").select("event_id", parsed_claim(answer).alias("c")).where("c IS NOT NULL")
    return found.select("event_id", "c.metric", F.size("c.operands").alias("operands"), "c.relation", "c.expected")


_CASE = "struct<id:string,reply:string,expect:string,expected:string,expect_contains:string,contains:string>"


def cases_of(datasets: DataFrame, key: str, json: str) -> DataFrame:
    """key, place, id, reply and needles of the evaluation cases of datasets, each JSON: a list, or an object with cases, items or tests.

    Needles are the texts that a reply should hold: ``expect_contains`` or
    ``contains``, one or a list, then ``expect`` or ``expected``; blank ones don't
    count. Datasets of no such form have no cases.
    """
    listed = F.from_json(json, f"array<{_CASE}>")
    named = F.from_json(json, f"cases array<{_CASE}>, items array<{_CASE}>, tests array<{_CASE}>")
    chosen = F.when(F.ltrim(json).startswith("["), listed).otherwise(F.coalesce(*[F.when(F.size(named[n]) > 0, named[n]) for n in ("cases", "items", "tests")]))
    each = datasets.select(key, F.posexplode(chosen).alias("place", "c")).where("c IS NOT NULL")
    extra = F.coalesce(*[F.when(~F.col(f"c.{n}").isin("", "[]"), F.col(f"c.{n}")) for n in ("expect_contains", "contains")])
    many = F.when(F.ltrim(extra).startswith("["), F.from_json(extra, "array<string>")).otherwise(F.when(extra.isNotNull(), F.array(extra)).otherwise(F.array().cast("array<string>")))
    last = stripped(F.coalesce(*[F.when(F.col(f"c.{n}") != "", F.col(f"c.{n}")) for n in ("expect", "expected")], F.lit("")))
    needles = F.concat(F.filter(many, lambda n: stripped(n) != ""), F.when(last != "", F.array(last)).otherwise(F.array().cast("array<string>")))
    return each.select(key, "place", "c.id", "c.reply", needles.alias("needles"))


def contains_score(reply: Column, needles: Column) -> Column:
    """The share of the needles that the reply holds, letters' case apart; 1 without needles."""
    blob = X.folded(F.coalesce(reply, F.lit("")))
    hits = F.size(F.filter(needles, lambda n: F.contains(blob, X.folded(n))))
    return F.when(F.size(needles) == 0, 1.0).otherwise(F.round(hits / F.size(needles), 4))


@query("""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, conv_id || '-' || turn AS id, text, turn FROM conversations),
n AS (SELECT *, list_concat(CASE WHEN turn % 3 = 0 THEN ['the', 'ZZZ', 'AN'] WHEN turn % 3 = 1 THEN ['of'] ELSE [] END, CASE WHEN turn % 2 = 0 THEN ['end.'] ELSE [] END) AS needles FROM c)
SELECT conv_id, place::INT AS place, id, len(needles)::INT AS needles, CASE WHEN len(needles) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(needles, lambda x: contains(lower(text), lower(x))))::DOUBLE / len(needles), 4) END AS score FROM n
""")
def s13_eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as datasets of cases in all forms a dataset may have, read back and scored."""
    turns = table(spark, sf_dir, "conversations")
    contains = F.when(F.col("turn") % 3 == 0, F.array(F.lit("the"), F.lit("ZZZ"), F.lit(" "), F.lit("AN")))
    case = F.struct("turn", "role", "text", F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("reply"), contains.alias("expect_contains"),
        F.when(F.col("turn") % 3 == 1, "of").alias("contains"), F.when(F.col("turn") % 2 == 0, " end. ").alias("expected"),
    )).alias("json"))
    ordered = F.array_sort(F.collect_list(case))
    body = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda c: c["json"]), ", "), F.lit("]"))
    name = F.element_at(F.array(F.lit("cases"), F.lit("items"), F.lit("tests")), (F.col("conv_id") % 4).cast("int"))
    form = F.when(F.col("conv_id") % 4 == 0, F.col("body")).otherwise(F.concat(F.lit('{"name": "x", "'), name, F.lit('": '), F.col("body"), F.lit("}")))
    datasets = turns.groupBy("conv_id").agg(body.alias("body")).select("conv_id", F.when(F.col("conv_id") % 4 == 0, F.col("body")).otherwise(form).alias("json"))
    cases = cases_of(datasets, "conv_id", "json")
    return cases.select("conv_id", "place", "id", F.size("needles").alias("needles"), contains_score(F.col("reply"), F.col("needles")).alias("score"))


EPSILON = 0.2


def _draw(*parts: Column) -> Column:
    """A number of 0 to 2 ** 32 - 1 that follows from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def pick(variations: DataFrame, group: str, name: str, score: str, uses: str, seed: str, epsilon: float = EPSILON) -> DataFrame:
    """The variation tried next in each group: mostly the best by score and uses, else one of the others.

    What chance decides follows from the seed and the group, so reruns agree
    and another seed explores elsewhere. A group of one has no others. Of
    equals the one whose name comes first is better. Null scores and uses count
    as zero.
    """
    plain = variations.select(group, name, F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(uses, F.lit(0)).alias("uses"))
    better = F.struct((-F.col("score")).alias("s"), (-F.col("uses")).alias("u"), F.col(name).alias("n"))
    best = plain.groupBy(group).agg(F.min(better).alias("best"), F.count("*").alias("size"))
    explores = (F.col("size") > 1) & (_draw(F.lit(seed), F.col(group).cast("string"), F.lit("explore")) < int(epsilon * 2**32))
    # The others are drawn by the least of numbers of their own, so none is gathered or ranked.
    drawn = F.struct(_draw(F.lit(seed), F.col(group).cast("string"), F.col(name).cast("string")).alias("d"), F.col(name).alias("n"))
    told = best.select(F.col(group).alias("of"), F.col("best.n").alias("top"), explores.alias("explores"))
    others = plain.join(told, F.col(group).eqNullSafe(F.col("of"))).where(~F.col("explores") | ~F.col(name).eqNullSafe(F.col("top")))
    chosen = others.groupBy("of", "top", "explores").agg(F.min(drawn).alias("other"))
    return chosen.select(F.col("of").alias(group), F.when(F.col("explores"), F.col("other.n")).otherwise(F.col("top")).alias(name), F.col("explores").alias("explored"))


@query(f"""
WITH v AS (SELECT p_brand AS intent, p_type || '/' || p_size AS variation, round(avg(p_retailprice), 4) AS score, count(*) AS uses FROM part GROUP BY 1, 2),
g AS (SELECT intent, count(*) AS size, arg_min(variation, (-score, -uses, variation)) AS top, ('0x' || left(md5('7|' || intent || '|explore'), 8))::BIGINT < {int(EPSILON * 2**32)} AND count(*) > 1 AS explored FROM v GROUP BY 1),
o AS (SELECT intent, arg_min(variation, (('0x' || left(md5('7|' || intent || '|' || variation), 8))::BIGINT, variation)) AS other FROM v JOIN g USING (intent) WHERE variation <> top GROUP BY 1)
SELECT intent, CASE WHEN explored THEN other ELSE top END AS variation, explored FROM g LEFT JOIN o USING (intent)
""")
def l3_bandit_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variation that each intent tries next."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("intent"), F.concat_ws("/", "p_type", "p_size").alias("variation")).agg(F.round(F.avg("p_retailprice"), 4).alias("score"), F.count("*").alias("uses"))
    return pick(rows, "intent", "variation", "score", "uses", "7")
