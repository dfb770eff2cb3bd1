"""Provenance of claims: the window of source sentences that carries each, with page, quote and span.

Sources are read as units of evidence, sentences with pages of which short ones
are joined. A window is one to three units in a row. It anchors a claim if they
share four tokens or more, covering 0.6 of the shorter side, and no quantity of
the claim is missing from the window. The best score counts, then the narrower
window, the smaller source, the earlier one.

Claims and windows meet by the rare tokens that a pair must share, as
``plans/matching.py`` says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.units import UNITS, evidence_units, units_of, whole_unit
from tessera.plans import matching
from tessera.plans.anchor import COMMON, MIN_WORDS, NEAR_MISS_CHARS, NEAR_MISSES, QUOTE_CHARS, by_rarity
from tessera.plans.matching import MIN_OVERLAP
from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import bounded, written

MAX_BROADCAST_ROWS = 200_000
#: A digit before each word in the order of rarity.
_RARE = "0"


def _units(rows: DataFrame, key: str, text: str, read: Callable, rank: Callable = sorted) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(units_of(read, rank), f"key {kind}, units {UNITS}")


def claim_units(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """claim_id, claim, words and numbers of the texts that are claims, and their most frequent words in order.

    A text is a claim if it has ``MIN_WORDS`` content tokens. Words are in the
    order of rarity among the claims.
    """
    read = written(_units(rows, key, text, whole_unit).select("key", F.explode("units").alias("u")).where(F.size("u.words") >= MIN_WORDS))
    counts = read.select(F.explode("u.words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    common = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(COMMON[-1]).collect()]
    return written(read.select(F.col("key").alias("claim_id"), F.col("u.sentence").alias("claim"), _ranked(F.col("u.words"), common).alias("words"), "u.numbers")), common


def _ranked(words: Column, common: list[str]) -> Column:
    """:func:`by_rarity` as an expression, for the few words of claims."""
    if not common:
        return F.transform(words, lambda w: F.concat(F.lit(_RARE), w))
    classes = F.create_map(*[F.lit(x) for place, word in enumerate(common) for x in (word, str(next(len(COMMON) - n for n, size in enumerate(COMMON) if place < size)))])
    return F.array_sort(F.transform(words, lambda w: F.concat(F.coalesce(classes[w], F.lit(_RARE)), w)))


def source_units(sources: DataFrame, key: str, text: str, common: list[str]) -> DataFrame:
    """source and units, the sentences of each source that can be evidence, words in the order of rarity; written, as it is read several times."""
    return written(_units(sources, key, text, evidence_units, by_rarity(common)).select(F.col("key").alias("source"), "units").where(F.size("units") > 0))


def fitting_windows(claims: DataFrame, sources: DataFrame, key: str, text: str, common: list[str]) -> DataFrame:
    """:func:`matching.fitting_pairs` of the claims and the units of sources.

    Few claims meet a text's windows as it is read, so its units are neither
    written nor passed on; many meet units that are written, as they are read
    several times.
    """
    few = matching.few_claims(claims, MAX_BROADCAST_ROWS)
    if few is None:
        return matching.fitting_pairs(claims, source_units(sources, key, text, common), MAX_BROADCAST_ROWS)
    rows = sources.select(F.col(key).alias("source"), F.col(text).alias("text"))
    return matching.pairs_of_texts(claims, few, rows, units_of(evidence_units, by_rarity(common)))


def provenance_of(claims: DataFrame, sources: DataFrame, key: str, text: str, common: list[str], best: DataFrame) -> DataFrame:
    """:func:`provenance` of the best windows, for which only their sources are read again."""
    best = written(best)
    chosen = sources.join(bounded(best.select(F.col("source").alias(key)).distinct(), MAX_BROADCAST_ROWS), key, "left_semi")
    return provenance(claims, source_units(chosen, key, text, common), best)


def provenance(claims: DataFrame, units: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """claim_id, source, page, quote, anchor_window, span and score of each claim that a source carries.

    ``claims`` as :func:`claim_units` gives them, ``units`` as
    :func:`source_units` does with the claims' common words. The quote is the
    sentence of the window that shares most with the claim, four tokens at
    least and the first of equal ones, or the whole window if none does, cut to
    280 characters. The page is that of the window's first sentence. ``best``
    are the windows to tell of, all claims' best ones if not given. Claims
    without an anchor have no row; texts that are null, empty or without
    tokens are no claims and no evidence.
    """
    # Written, as it is read three times and costs the whole search.
    best = written(matching.best_pairs(claims, units, MAX_BROADCAST_ROWS) if best is None else best)
    # Only chosen sources are put apart into windows.
    chosen = units.join(bounded(best.select("source").distinct(), MAX_BROADCAST_ROWS), "source", "left_semi")
    near = matching.near(chosen, "sentence", "page", "words").join(bounded(best.select("source", "start").distinct(), MAX_BROADCAST_ROWS), ["source", "start"], "left_semi")
    met = best.join(near, ["source", "start"]).join(claims.select("claim_id", F.col("words").alias("cw")), "claim_id").withColumn("inside", F.slice("near", F.lit(1), F.col("width")))

    def fit(u: Column, i: Column) -> Column:
        shared = F.size(F.array_intersect("cw", u["words"]))
        score = F.when(shared >= MIN_OVERLAP, shared / F.least(F.size("cw"), F.size(u["words"])))
        return F.struct(score.alias("fit"), (-i).alias("place"), u["sentence"].alias("sentence"))

    top = F.array_max(F.transform("inside", fit))
    window = F.array_join(F.col("inside")["sentence"], " ")
    quote = F.when(top["fit"].isNotNull(), top["sentence"]).otherwise(window)
    span = F.concat_ws("-", "start", F.col("start") + F.col("width") - 1)
    return met.select(
        "claim_id",
        "source",
        F.col("inside")[0]["page"].alias("page"),
        F.trim(F.substring(quote, 1, QUOTE_CHARS)).alias("quote"),
        window.alias("anchor_window"),
        span.alias("span"),
        F.round("score", 6).alias("score"),
    )


def near_misses(claims: DataFrame, units: DataFrame, most: int = NEAR_MISSES) -> DataFrame:
    """The sentences that came closest to a claim without reaching the floor: claim_id, rank, source, position, sentence, score."""
    told = units.select("source", F.posexplode("units").alias("position", "u"))
    best = matching.missed_sentences(claims, told.select("source", "position", "u.words"), most, MAX_BROADCAST_ROWS)
    shown = told.select("source", "position", F.substring("u.sentence", 1, NEAR_MISS_CHARS).alias("sentence"))
    return best.join(shown, ["source", "position"]).select("claim_id", "rank", "source", "position", "sentence", F.round("score", 6).alias("score"))


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources whose every line is a page."""
    line = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.lit("--- Page "), i + 1, F.lit(" ---\n"), t))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.array_join(line, "\n").alias("text"))


def _benchmark_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The benchmark's passages, a claim each."""
    return claim_units(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def v1_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of the benchmark's passages in the pages of all documents."""
    claims, common = _benchmark_claims(spark, sf_dir)
    documents = (paged_documents(spark, sf_dir), "doc_id", "text", common)
    return provenance_of(claims, *documents, matching.best_of(fitting_windows(claims, *documents)))


@query()
def v20_provenance_gained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passages gain that were anchored in English documents, once the documents of all languages are there."""
    claims, common = _benchmark_claims(spark, sf_dir)
    documents = (paged_documents(spark, sf_dir), "doc_id", "text", common)
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("source"))
    return provenance_of(claims, *documents, matching.gained_pairs(fitting_windows(claims, *documents), english))


@query()
def v8_missed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three source sentences that came closest to each passage without anchoring it."""
    claims, common = _benchmark_claims(spark, sf_dir)
    return near_misses(claims, source_units(paged_documents(spark, sf_dir), "doc_id", "text", common))


@query()
def t6_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities that each document's text states, references left out."""
    rows = _units(table(spark, sf_dir, "documents"), "doc_id", "text", whole_unit)
    return rows.select(F.col("key").alias("doc_id"), F.explode("units").alias("u")).select("doc_id", "u.numbers")
