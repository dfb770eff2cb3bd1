"""The gate that a draft passes before it is kept: disclosure, grounding, opening word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.orders import collapsed, may_be_evidence, may_order, stripped, stripped_order_flags
from tessera.functions.text import folded
from tessera.functions.runs import RUN, runs_with, sample_texts, shared_runs
from tessera.plans.matching import MAX_BROADCAST_ROWS, best_of
from tessera.plans.provenance import claim_units, fitting_windows, paged_documents
from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import bounded, stored, written

LEAST_ANCHORED = 0.5
#: So many drafts and characters of them are sent to every task at most.
MAX_DRAFTS = 10_000
MAX_DRAFT_CHARS = 4_000_000
#: So many sentences are tried first for each opening word.
TRIED = 16

#: First words of a question, and words that name the sources.
QUESTION_WORDS = "what which how why when where who whose does do did is are was were can could should would will may might".split()
SOURCE_WORDS = ["sources?", "source material", "source document", "uploaded document", "provided document", "reference material", "substrate", "input document", "material provided"]


def echoes(drafts: DataFrame, texts: DataFrame) -> DataFrame:
    """key, other, window, length and run of each draft and protected text that share ``RUN`` characters or more.

    drafts: key and text, with white space collapsed; texts: other and text,
    whose white space is collapsed here. The window is the text's first ``RUN``
    characters that the draft has too, the run the longest one shared, the
    first of equal ones. Both are sampled by winnowing, and only those with a
    mark in common are compared, in full. Few drafts are sent to every task and
    meet the texts as these are read; for many, marks are joined, and a text is
    marked once by each hash, so repeated passages bring a pair together once.
    Null and shorter texts share nothing.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((drafts, "key"), (texts, "other"))]
    count, chars = drafts.agg(F.count("*"), F.sum(F.length("text"))).first()
    if count <= MAX_DRAFTS and (chars or 0) <= MAX_DRAFT_CHARS:
        few = drafts.select("key", F.coalesce("text", F.lit("")).alias("text")).toArrow()
        return texts.select("other", "text").mapInArrow(runs_with(few), f"key {kinds[0]}, other {kinds[1]}, window string, length long, run string")
    texts = texts.select("other", collapsed(F.col("text")).alias("text"))
    own = drafts.select("key", "text").mapInArrow(sample_texts, f"key {kinds[0]}, mark long")
    theirs = texts.mapInArrow(sample_texts, f"key {kinds[1]}, mark long").withColumnRenamed("key", "other")
    pairs = theirs.join(bounded(written(own), MAX_BROADCAST_ROWS), "mark").select("key", "other").distinct()
    both = pairs.join(texts, "other").join(drafts.select("key", F.col("text").alias("draft")), "key")
    found = both.select("key", "other", "draft", "text").mapInArrow(shared_runs, f"key {kinds[0]}, other {kinds[1]}, first long, length long, place long")
    at = lambda start, size: F.substring("text", F.col(start).cast("int") + 1, size)
    return found.join(texts, "other").select("key", "other", at("first", F.lit(RUN)).alias("window"), "length", at("place", F.col("length").cast("int")).alias("run"))


def without_ask(prompt: Column, ask: Column) -> Column:
    """The prompt with the user's own words blanked, which a draft may restate."""
    own = F.coalesce(ask, F.lit(""))
    return F.when(own != "", F.replace(prompt, own, F.repeat(F.lit(" "), F.length(own)))).otherwise(prompt)


def _plain_parts(text: Column) -> Column:
    """The words of :func:`normal_tokens`, empty ones among them. The text is folded as a whole, so a final sigma is told from others by no word's end."""
    kept = F.regexp_replace(F.translate(folded(text), "ς", "σ"), r"(?U)[\w&&[^\p{L}\p{N}]]+", "")
    return F.split(kept, r"(?U)[^\w]+")


def normal_tokens(text: Column) -> Column:
    """Letters and digits of the words, case folded, in order."""
    return F.filter(_plain_parts(text), lambda t: t != "")


def asks_sources(sentence: Column) -> Column:
    """Whether a sentence hands the question to the sources: it asks, or names them."""
    return F.endswith(sentence, F.lit("?")) | sentence.rlike(rf"(?iU)^(?:{'|'.join(QUESTION_WORDS)})\b") | sentence.rlike(rf"(?iU)\b(?:{'|'.join(SOURCE_WORDS)})\b")


def ungrounded_openings(drafts: DataFrame, sources: DataFrame, text: str) -> DataFrame:
    """key and token of drafts that open on a word which no source sentence that may be evidence has; null for a draft without words.

    The sources' words are not gathered: the few opening words are sought in
    them. A word needs one sentence that may be evidence, so the structure of
    ``TRIED`` of its sentences is looked at first, and of all only for words
    that none of these carries.
    """
    first = F.get(F.split(collapsed(F.col("text")), r"(?<=[.!?])\s+"), F.lit(0))
    opened = written(drafts.select("key", F.get(normal_tokens(F.col("text")), F.lit(0)).alias("token"), asks_sources(first).alias("asks")).where(~F.coalesce("asks", F.lit(False))))
    sentences = sources.select(F.explode(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+")).alias("s")).where("s <> ''")

    def told(rows: DataFrame, words: DataFrame) -> DataFrame:
        return rows.select("s", F.explode(_plain_parts(F.col("s"))).alias("token")).join(bounded(words, MAX_BROADCAST_ROWS), "token")

    def carried(rows: DataFrame, words: DataFrame) -> DataFrame:
        # Written first, as Spark would look at the structure of all sentences before it seeks the words in them.
        return written(written(told(rows, words)).where(may_be_evidence(F.col("s"))).select("token").distinct())

    asked = opened.select("token").where("token IS NOT NULL").distinct()
    mark = F.xxhash64("s").alias("mark")
    picked = written(told(sentences, asked).select("token", mark).groupBy("token", F.pmod("mark", F.lit(TRIED))).agg(F.min("mark").alias("mark")).select("token", "mark"))
    tried = sentences.select("s", mark).join(bounded(picked.select("mark").distinct(), MAX_BROADCAST_ROWS), "mark", "left_semi").select("s").distinct()
    found = carried(tried, asked)
    rest = picked.join(found, "token", "left_anti").select("token").distinct()
    if not rest.isEmpty():
        found = found.unionByName(carried(sentences, rest))
    return opened.join(found, "token", "left_anti").select("key", "token")


def draft_outcomes(drafts: DataFrame, prompts: DataFrame, sources: DataFrame, source_key: str, text: str) -> DataFrame:
    """key, eligible, anchored and outcome of each draft (key, text): the first rule that refuses it, or ok.

    A draft is refused that holds 40 characters of a prompt (other, text) as
    they stand, white space apart; of whose paragraphs none is anchored in the
    sources, or less than half of those that are claims; or that opens on a
    word no source has, unless it opens with a question. ``sources`` hold pages
    marked as in ``paged_documents``.
    """
    plain = written(drafts.select("key", collapsed(F.col("text")).alias("text")))
    disclosed = echoes(plain, prompts).select("key").distinct().withColumn("disclosed", F.lit(True))
    paragraphs = drafts.select("key", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    named = paragraphs.select(F.concat_ws("-", "key", "line").alias("id"), "key", "paragraph")
    claims, common = claim_units(named, "id", "paragraph")
    anchored = best_of(fitting_windows(claims, sources, source_key, text, common)).select("claim_id", F.lit(1).alias("hit"))
    counted = claims.select("claim_id").join(anchored, "claim_id", "left").join(named.select(F.col("id").alias("claim_id"), "key"), "claim_id")
    counts = counted.groupBy("key").agg(F.count("*").alias("eligible"), F.count("hit").alias("anchored"))
    openings = ungrounded_openings(drafts, sources, text).select("key", F.lit(True).alias("unopened"))
    met = drafts.select("key").join(disclosed, "key", "left").join(counts, "key", "left").join(openings, "key", "left").fillna(0, ["eligible", "anchored"])
    outcome = (
        F.when(F.col("disclosed"), "system_prompt_disclosure")
        .when(F.col("anchored") == 0, "zero_anchored_claims")
        .when(F.col("anchored") / F.col("eligible") < LEAST_ANCHORED, "anchored_ratio_below_floor")
        .when(F.col("unopened"), "opening_token_ungrounded")
        .otherwise("ok")
    )
    return met.select("key", "eligible", "anchored", outcome.alias("outcome"))


@query()
def v7_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each benchmark passage shares word for word with each document."""
    drafts = written(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), collapsed(F.col("text")).alias("text")))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("other"), "text")
    return echoes(drafts, texts).withColumnsRenamed({"key": "item_id", "other": "doc_id"})


def benchmark_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts made of the passages, one sentence a paragraph, some behind a question; those whose number a conversation has end on its system turn."""
    said = table(spark, sf_dir, "conversations").where("role = 'system'").groupBy("conv_id").agg(F.min("text").alias("said"))
    passages = table(spark, sf_dir, "benchmark").join(said, F.col("item_id") == F.col("conv_id"), "left")
    lines = F.regexp_replace("text", r"(?<=[.!?])\s+", "\n")
    opening = F.when(F.col("item_id") % 3 == 0, "What do the sources say?\n").when(F.col("item_id") % 3 == 1, "Zyzzyva opens here\n").otherwise("")
    return passages.select(F.col("item_id").alias("key"), F.concat(opening, lines, F.coalesce(F.concat(F.lit("\n"), "said"), F.lit(""))).alias("text"))


@query()
def v7_draft_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether drafts made of the benchmark's passages are kept, against all documents and all system turns."""
    turns = table(spark, sf_dir, "conversations").where("role = 'system'")
    prompts = turns.select(F.concat_ws(":", "conv_id", "turn").alias("other"), "text")
    return draft_outcomes(stored(benchmark_drafts(spark, sf_dir)), prompts, paged_documents(spark, sf_dir), "doc_id", "text")


@query()
def t25_order_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tests of each sentence of every document that meets one."""
    parts = F.transform(F.split("text", r"(?U)(?<=[.!?])\s+"), stripped)
    sentences = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("position", "s")).where(may_order(F.col("s")))
    flagged = sentences.select("doc_id", "position", *[flag.alias(name) for name, flag in stripped_order_flags(F.col("s")).items()])
    return flagged.where("addressed OR reader_acts OR deliverable OR pointing OR imperative")
