"""Anchoring claims to the runs of source sentences that carry them.

A claim and a window of one to three sentences are compared by the content
words they share: at least four, covering at least 0.6 of the shorter side,
and no number of the claim missing from the window. ``plans/matching.py`` says
how they meet. Windows are held by position until one is chosen; text is
fetched for chosen ones only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.functions.text import content_words, plain_numbers, sentences
from tessera.functions.units import plain_units, units_of
from tessera.plans.matching import MIN_OVERLAP, best_of, few_claims, fitting_pairs, gained_pairs, missed_sentences, pairs_of_texts
from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import stored, written

MIN_WORDS = 4
NEAR_MISSES = 3
QUOTE_CHARS = 280
NEAR_MISS_CHARS = 300


def claims_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The sentences that are claims: claim_id, words and numbers; at least ``MIN_WORDS`` content words."""
    each = rows.select(key, F.posexplode(sentences(F.col(text))).alias("position", "claim"))
    return each.select(F.concat_ws("-", key, "position").alias("claim_id"), "claim", content_words(F.col("claim")).alias("words"), plain_numbers(F.col("claim")).alias("numbers")).where(
        F.size("words") >= MIN_WORDS
    )


def source_sentences(sources: DataFrame, key: str, text: str) -> DataFrame:
    """source, position among the source's eligible sentences, sentence, its words and numbers."""
    parts = F.filter(F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("sentence"), content_words(s).alias("words"), plain_numbers(s).alias("numbers"))), lambda s: F.size(s["words"]) >= MIN_OVERLAP)
    rows = sources.select(F.col(key).alias("source"), F.posexplode(parts).alias("position", "s"))
    return rows.select("source", "position", "s.sentence", "s.words", "s.numbers")


#: The claims' most frequent words are so many classes; they only set the order in which words count as rare.
COMMON = (16, 64, 512)


def common_words(claims: DataFrame) -> list[str]:
    """The most frequent words of the claims, at most the last of ``COMMON``."""
    counts = claims.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(COMMON[-1]).collect()]


def ranked(words: Column, common: list[str]) -> Column:
    """The words, each behind a digit for how frequent it is, in order: the rare ones first.

    Strings, since Spark compares structs in arrays pair by pair.
    """

    def marked(w: Column) -> Column:
        found = F.concat(F.lit("0"), w)
        for place, n in enumerate(reversed(COMMON)):
            found = F.when(w.isin(common[:n]), F.concat(F.lit(str(place + 1)), w)).otherwise(found)
        return found

    return F.array_sort(F.transform(words, marked))


def by_rarity(common: list[str]) -> Callable[[set[str]], list[str]]:
    """:func:`ranked` for the words that Python reads."""
    marked = {word: f"{next(len(COMMON) - n for n, size in enumerate(COMMON) if place < size)}{word}" for place, word in enumerate(common)}

    def rank(words: set[str]) -> list[str]:
        return sorted([marked.get(w) or "0" + w for w in words])

    return rank


def source_parts(sources: DataFrame, key: str, text: str, common: list[str]) -> DataFrame:
    """source and units, the ranked words and the numbers of its eligible sentences in order; written, since it is read several times."""
    each = sources.select(F.col(key).alias("source"), F.posexplode(sentences(F.col(text))).alias("at", "sentence"))
    found = each.select("source", "at", content_words(F.col("sentence")).alias("words"), plain_numbers(F.col("sentence")).alias("numbers"))
    part = F.struct("at", ranked(F.col("words"), common).alias("words"), "numbers")
    return written(found.where(F.size("words") >= MIN_OVERLAP).select("source", part.alias("part")).groupBy("source").agg(F.array_sort(F.collect_list("part")).alias("units")))


def fitting_windows(claims: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """All windows in the sentences of sources that reach the floor for a claim, as ``fitting_pairs`` gives them.

    Few claims meet a text's windows as it is read; for many its sentences are
    gathered and written, as they are read several times.
    """
    common = common_words(claims)
    asked = claims.select("claim_id", ranked(F.col("words"), common).alias("words"), "numbers")
    few = few_claims(asked)
    if few is None:
        return fitting_pairs(asked, source_parts(sources, key, text, common))
    rows = sources.select(F.col(key).alias("source"), F.col(text).alias("text"))
    return pairs_of_texts(asked, few, rows, units_of(plain_units, by_rarity(common)))


def anchors(claims: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """The best windows of claims in the sentences of sources."""
    return best_of(fitting_windows(claims, sources, key, text)).withColumn("score", F.round("score", 6))


def _sentence_rows(name: str, rows: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, unnest(range(len(ss))) AS pos0, unnest(ss) AS s FROM (SELECT {key}, {sql.sentences('text')} AS ss FROM {rows}))"


_ANCHOR_SQL = f"""
{_sentence_rows("cs", "benchmark", "item_id")},
cl AS (SELECT item_id || '-' || pos0 AS claim_id, s AS claim, {sql.content_words("s")} AS ws, {sql.plain_numbers("s")} AS ns FROM cs WHERE len({sql.content_words("s")}) >= 4),
{_sentence_rows("ds", "documents", "doc_id")},
e AS (SELECT doc_id AS source, row_number() OVER (PARTITION BY doc_id ORDER BY pos0) - 1 AS pos, s, {sql.content_words("s")} AS ws, {sql.plain_numbers("s")} AS ns FROM ds WHERE len({sql.content_words("s")}) >= 4),
w AS (SELECT source, pos AS start, 1 AS width, ws, ns FROM e
  UNION ALL SELECT a.source, a.pos, 2, list_distinct(list_concat(a.ws, b.ws)), list_distinct(list_concat(a.ns, b.ns)) FROM e a JOIN e b ON a.source = b.source AND b.pos = a.pos + 1
  UNION ALL SELECT a.source, a.pos, 3, list_distinct(list_concat(a.ws, list_concat(b.ws, c.ws))), list_distinct(list_concat(a.ns, list_concat(b.ns, c.ns))) FROM e a JOIN e b ON a.source = b.source AND b.pos = a.pos + 1 JOIN e c ON a.source = c.source AND c.pos = a.pos + 2),
cw AS (SELECT claim_id, unnest(ws) AS word FROM cl), ww AS (SELECT source, start, width, unnest(ws) AS word FROM w),
sh AS (SELECT claim_id, source, start, width, count(*) AS shared FROM cw JOIN ww USING (word) GROUP BY ALL HAVING count(*) >= 4),
sc AS (SELECT sh.claim_id, sh.source, sh.start, sh.width, shared::DOUBLE / least(len(cl.ws), len(w.ws)) AS score FROM sh JOIN cl USING (claim_id) JOIN w ON w.source = sh.source AND w.start = sh.start AND w.width = sh.width
  WHERE len(list_filter(cl.ns, lambda n: NOT list_contains(w.ns, n))) = 0),
an AS (SELECT claim_id, source, start, width, round(score, 6) AS score FROM sc WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY sc.score DESC, width, source, start) = 1)"""


@query(f"WITH {_ANCHOR_SQL} SELECT claim_id, source, start::INT AS start, width::INT AS width, score FROM an")
def v1_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the benchmark's claims in the documents."""
    claims = claims_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return anchors(claims, table(spark, sf_dir, "documents"), "doc_id", "text")


def reanchored(claims: DataFrame, sources: DataFrame, key: str, text: str, held: DataFrame) -> DataFrame:
    """The anchors that claims gain over updated sources: none from a source that ``held`` (claim_id, source) cites for the claim already."""
    return anchors(claims, sources, key, text).join(held.select("claim_id", "source"), ["claim_id", "source"], "left_anti")


def reanchored_within(claims: DataFrame, sources: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """The same where the anchors held so far are those among the sources of ``known`` (source), from one search."""
    return gained_pairs(fitting_windows(claims, sources, key, text), known).withColumn("score", F.round("score", 6))


def append_gained(rows: DataFrame, path: str) -> bool:
    """Appends the rows to the files of ``path`` and says whether there were any; without rows nothing is written."""
    rows = stored(rows)
    if rows.isEmpty():
        return False
    rows.write.mode("append").parquet(path)
    return True


@query(f"""
WITH {_ANCHOR_SQL},
held AS (SELECT claim_id, source FROM sc WHERE score >= 0.6 AND source IN (SELECT doc_id FROM documents WHERE lang = 'en')
  QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY sc.score DESC, width, source, start) = 1)
SELECT claim_id, source, start::INT AS start, width::INT AS width, score FROM an ANTI JOIN held USING (claim_id, source)
""")
def v20_reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the benchmark's claims, anchored in English documents, gain once the documents of all languages are there."""
    claims = claims_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    docs = table(spark, sf_dir, "documents")
    return reanchored_within(claims, docs, "doc_id", "text", docs.where("lang = 'en'").select(F.col("doc_id").alias("source")))


def quoted_anchors(claims: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """Anchors with the sentence inside the window that fits the claim best, or the whole window if none does."""
    # Written, as it is read twice and costs the whole search.
    found = written(anchors(claims, sources, key, text))
    parts = source_sentences(sources.join(found.select(F.col("source").alias(key)).distinct(), key, "left_semi"), key, text)
    inside = found.join(parts, "source").where("position >= start AND position < start + width").join(claims.select("claim_id", F.col("words").alias("cw")), "claim_id")
    shared = F.size(F.array_intersect("cw", "words"))
    score = F.when(shared >= MIN_OVERLAP, shared / F.least(F.size("cw"), F.size("words"))).otherwise(F.lit(0.0))
    best = inside.withColumn("fit", score).groupBy("claim_id", "source", "start", "width", "score").agg(
        F.max_by("sentence", F.struct("fit", (-F.col("position")).alias("p"))).alias("sentence"),
        F.max("fit").alias("fit"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "sentence"))), lambda s: s["sentence"]), " ").alias("window"),
    )
    quote = F.when(F.col("fit") > 0, F.col("sentence")).otherwise(F.col("window"))
    return best.select("claim_id", "source", "start", "width", "score", F.trim(F.substring(quote, 1, QUOTE_CHARS)).alias("quote"))


@query(f"""
WITH {_ANCHOR_SQL},
ins AS (SELECT an.*, e.pos, e.s, CASE WHEN len(list_intersect(cl.ws, e.ws)) >= 4 THEN len(list_intersect(cl.ws, e.ws))::DOUBLE / least(len(cl.ws), len(e.ws)) ELSE 0.0::DOUBLE END AS fit
  FROM an JOIN cl USING (claim_id) JOIN e ON e.source = an.source AND e.pos >= an.start AND e.pos < an.start + an.width)
SELECT claim_id, source, start::INT AS start, width::INT AS width, score,
       trim(left(CASE WHEN max(fit) > 0 THEN arg_max(s, (fit, -pos)) ELSE string_agg(s, ' ' ORDER BY pos) END, 280)) AS quote FROM ins GROUP BY 1, 2, 3, 4, 5
""")
def v1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the benchmark's claims with their quotes."""
    claims = claims_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return quoted_anchors(claims, table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH {_ANCHOR_SQL}, e1 AS (SELECT source, pos, left(s, 300) AS sentence, ws, unnest(ws) AS word FROM e),
n AS (SELECT cw.claim_id, source, pos, any_value(sentence) AS sentence, count(*)::DOUBLE / least(any_value(len(cl.ws)), any_value(len(e1.ws))) AS score
  FROM cw JOIN e1 USING (word) JOIN cl USING (claim_id) GROUP BY 1, 2, 3 HAVING count(*) >= 4)
SELECT claim_id, source, pos::INT AS position, sentence, round(score, 6) AS score FROM n WHERE score < 0.6 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY n.score DESC, source, pos) <= 3
""")
def v8_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three source sentences that came closest to a claim without anchoring it."""
    claims = claims_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    common = common_words(claims)
    order = lambda rows: rows.withColumn("words", ranked(F.col("words"), common))
    parts = source_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")
    chosen = missed_sentences(order(claims), written(order(parts.select("source", "position", "words"))), NEAR_MISSES)
    shown = parts.select("source", "position", F.substring("sentence", 1, NEAR_MISS_CHARS).alias("sentence"))
    return chosen.join(shown, ["source", "position"]).select("claim_id", "source", "position", "sentence", F.round("score", 6).alias("score"))


@query(f"""
WITH {_ANCHOR_SQL}, c AS (SELECT split_part(cl.claim_id, '-', 1)::BIGINT AS item_id, count(*) AS eligible, count(an.source) AS anchored FROM cl LEFT JOIN an USING (claim_id) GROUP BY 1)
SELECT item_id, eligible, anchored, eligible - anchored AS unanchored, CASE WHEN anchored = 0 THEN 'zero_anchored_claims' WHEN anchored::DOUBLE / eligible < 0.5 THEN 'anchored_ratio_below_floor' ELSE 'ok' END AS outcome FROM c
""")
def v7_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each draft is refused: nothing anchored, or less than half of its claims."""
    claims = claims_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    found = anchors(claims, table(spark, sf_dir, "documents"), "doc_id", "text").select("claim_id", F.lit(1).alias("hit"))
    item = F.split("claim_id", "-")[0].cast("long").alias("item_id")
    counted = claims.select("claim_id").join(found, "claim_id", "left").groupBy(item).agg(F.count("*").alias("eligible"), F.count("hit").alias("anchored"))
    outcome = F.when(F.col("anchored") == 0, "zero_anchored_claims").when(F.col("anchored") / F.col("eligible") < 0.5, "anchored_ratio_below_floor").otherwise("ok")
    return counted.select("item_id", "eligible", "anchored", (F.col("eligible") - F.col("anchored")).alias("unanchored"), outcome.alias("outcome"))
