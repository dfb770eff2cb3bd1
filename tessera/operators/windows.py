"""Window operators: sentence windows, running budgets, numbering, neighbours, renumbering, best candidates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import sentences
from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import stored

PER_FILE_CHARS = 4_000
TOTAL_CHARS = 16_000
CARRY_PER_FILE_CHARS = 200_000
CARRY_TOTAL_CHARS = 400_000
MAX_WINDOW = 3


def document_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, position (from 0) and sentence of each document."""
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("position", "sentence"))


def sentence_windows(rows: DataFrame, key: str, size: int = MAX_WINDOW) -> DataFrame:
    """Runs of 1 to ``size`` consecutive sentences of each document: first position, width and text.

    ``rows`` has one array of sentences for each key, so runs are slices and nothing is shuffled.
    """
    starts = rows.select(key, "sentences", F.explode(F.sequence(F.lit(1), F.size("sentences"))).alias("first")).where("size(sentences) > 0")
    widths = F.sequence(F.lit(1), F.least(F.lit(size), F.size("sentences") - F.col("first") + 1))
    runs = starts.select(key, "sentences", "first", F.explode(widths).alias("width"))
    return runs.select(key, (F.col("first") - 1).alias("start"), "width", F.array_join(F.slice("sentences", F.col("first"), F.col("width")), " ").alias("window"))


SENTENCES_SQL = r"list_filter(list_transform(string_split_regex({text}, '[.!?\n]+'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"


@query(f"""
WITH s AS (SELECT item_id, {SENTENCES_SQL.format(text="text")} AS ss FROM benchmark),
     f AS (SELECT item_id, ss, unnest(range(1, len(ss) + 1)) AS first FROM s),
     w AS (SELECT item_id, ss, first, unnest(range(1, least(3, len(ss) - first + 1) + 1)) AS width FROM f)
SELECT item_id, (first - 1)::INT AS start, width::INT AS width, array_to_string(ss[first:first + width - 1], ' ') AS "window" FROM w
""")
def w1_sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", sentences(F.col("text")).alias("sentences"))
    return sentence_windows(rows, "item_id")


def source_budget(sources: DataFrame, group: str, order: list[Column], chars: str, per_file: int = PER_FILE_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """Characters carried of each source: at most ``per_file``, and ``total`` in a group, the source that crosses it in part.

    Columns come in ascending order, the last telling rows apart.
    """
    capped = F.least(F.col(chars), F.lit(per_file))
    rows = sources.withColumn("place", F.struct(*order)).withColumn("capped", capped)
    carried = F.greatest(F.lit(0), F.least(F.col("capped"), F.lit(total) - F.col("ahead"))).cast("long")
    summed = running_totals(rows, group, "place", "capped").withColumn("carried", carried)
    return summed.withColumn("truncated", (F.col("carried") > 0) & (F.col("carried") < F.col(chars))).drop("place", "capped", "ahead")


@query("""
SELECT doc_id, source, n_chars, carried, carried > 0 AND carried < n_chars AS truncated FROM (
  SELECT doc_id, source, n_chars, greatest(0, least(least(n_chars, 4000), 16000 - coalesce(sum(least(n_chars, 4000)) OVER (
    PARTITION BY source ORDER BY quality DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS carried
  FROM (SELECT d.*, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)))
""")
def w2_source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    order = [(-F.coalesce("quality", F.lit(0))).alias("q"), F.col("doc_id")]
    return source_budget(ranked, "source", order, "n_chars").select("doc_id", "source", "n_chars", "carried", "truncated")


def source_carry(sources: DataFrame, group: str, order: list[Column], chars: str, per_file: int = CARRY_PER_FILE_CHARS, total: int = CARRY_TOTAL_CHARS) -> DataFrame:
    """Whether each source is carried whole: the first that would cross ``total`` stops it and all after it."""
    rows = sources.withColumn("place", F.struct(*order)).withColumn("block", F.least(F.col(chars), F.lit(per_file)))
    # Lengths aren't negative, so the running sum passes the total once and for all.
    return running_totals(rows, group, "place", "block").withColumn("carried", F.col("ahead") + F.col("block") <= total).drop("place", "block", "ahead")


@query("""
SELECT doc_id, source, n_chars, sum(least(n_chars, 200000)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 40000 AS carried FROM documents
""")
def w3_source_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_carry(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.col("doc_id")], "n_chars", total=40_000)


def running_totals(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``rows`` with ``ahead``, the sum of ``value`` over the rows of the group before each one in order of ``key``.

    Rows are dealt by ranges of group and key, so a group may span many
    partitions: each is summed in order by itself, and the sums of those
    before it are added. Only one row for each group and partition meets in a
    window over a group.
    """
    ranged = stored(rows.repartitionByRange(group, key).withColumn("slice", F.spark_partition_id()))
    totals = ranged.groupBy(group, "slice").agg(F.sum(value).alias("slice_sum"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("of"), F.col("slice").alias("of_slice"), F.coalesce(F.sum("slice_sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(group, "slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    met = summed.join(offsets, F.col(group).eqNullSafe(F.col("of")) & (F.col("slice") == F.col("of_slice")))
    return met.withColumn("ahead", F.col("offset") + F.col("within")).drop("of", "of_slice", "offset", "within", "slice")


def sentence_numbers(docs: DataFrame) -> DataFrame:
    """Sentences of documents, numbered S1 to Sn over each source's documents.

    Documents are numbered by a running sum of their sentence counts over ids
    and counts alone; texts are split again where the numbers are given out.
    """
    split = docs.select("source", "doc_id", sentences(F.col("text")).alias("ss"))
    ahead = running_totals(split.select("source", "doc_id", F.size("ss").alias("n")), "source", "doc_id", "n").select("doc_id", "ahead")
    each = split.join(ahead, "doc_id").select("source", "doc_id", "ahead", F.posexplode("ss").alias("position", "sentence"))
    return each.select("source", "doc_id", "position", F.concat(F.lit("S"), F.col("ahead") + F.col("position") + 1).alias("sid"), F.length("sentence").alias("chars"))


NUMBERS_SQL = f"""
WITH s AS (SELECT source, doc_id, unnest(range(len(ss))) AS position, unnest(ss) AS sentence FROM (
  SELECT source, doc_id, {SENTENCES_SQL.format(text="text")} AS ss FROM documents))
SELECT source, doc_id, position::INT AS position, 'S' || row_number() OVER (PARTITION BY source ORDER BY doc_id, position) AS sid, length(sentence) AS chars FROM s
"""


@query(NUMBERS_SQL)
def w4_sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all documents' sentences."""
    return sentence_numbers(table(spark, sf_dir, "documents"))


@query(NUMBERS_SQL)
def w4_all_sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its second name."""
    return w4_sentence_numbers(spark, sf_dir)


@query("""
SELECT conv_id, turn, role, lag(text) OVER w AS before, text AS here, lead(text) OVER w AS after FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
""")
def w5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before and the one after."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    here = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag(here).over(order).alias("before"), here.alias("here"), F.lead(here).over(order).alias("after"))


def merge_short(parts: Column, least: int) -> Column:
    """Sentences with fewer than ``least`` words joined to what follows until they have as many; a short rest stays by itself.

    What a run holds depends on the runs before it, so each array is read once
    from start to end, in Arrow batches; a run's words are those of its parts.
    """

    @F.pandas_udf("array<string>")
    def merged(lists: pd.Series) -> pd.Series:
        return lists.map(lambda each: None if each is None else list(_merged(each, least)))

    return merged(parts)


def _merged(parts: Iterable[str], least: int) -> Iterator[str]:
    run: list[str] = []
    seen: set[str] = set()
    for part in parts:
        run.append(part)
        seen.update(re.findall("[a-z0-9]+", part.lower()))
        if len(seen) >= least:
            yield " ".join(run).strip(" ")
            run, seen = [], set()
    if run:
        yield " ".join(run).strip(" ")


#: Sentences are joined by the numbers of their runs: a run ends where its distinct words are enough, which a recursion finds one by one.
@query(f"""
WITH RECURSIVE s AS (SELECT item_id, {SENTENCES_SQL.format(text="text")} AS ss FROM benchmark),
r AS (SELECT item_id, ss, 0 AS first, 0 AS last, -1 AS position FROM s
  UNION ALL SELECT item_id, ss, first, last, position + 1 FROM (SELECT item_id, ss, r.last + 1 AS first,
    coalesce(list_min(list_filter(range(r.last + 1, len(ss) + 1), lambda e: len(list_distinct(regexp_extract_all(lower(array_to_string(ss[r.last + 1:e], ' ')), '[a-z0-9]+'))) >= 4)), len(ss)) AS last, position
    FROM r WHERE r.last < len(ss)))
SELECT item_id, position::INT AS position, trim(array_to_string(ss[first:last], ' ')) AS sentence FROM r WHERE position >= 0
""")
def w6_merged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", merge_short(sentences(F.col("text")), 4).alias("merged"))
    return rows.select("item_id", F.posexplode("merged").alias("position", "sentence"))


def paged_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences with the page of the last ``--- Page N ---`` mark before them, null before the first."""
    marked = F.split(F.regexp_replace(F.col(text), r"--- Page (\d+) ---", "\x01$1\x02"), "\x01")
    pieces = docs.select(key, F.posexplode(marked).alias("piece", "body"))
    page = F.when(F.col("piece") > 0, F.regexp_extract("body", "^([0-9]+)\x02", 1).cast("int"))
    body = F.when(F.col("piece") > 0, F.regexp_replace("body", "^[0-9]+\x02", "")).otherwise(F.col("body"))
    return pieces.select(key, page.alias("page"), "piece", F.posexplode(sentences(body)).alias("position", "sentence"))


@query(f"""
WITH d AS (SELECT conv_id || '-' || turn AS draft, text FROM conversations),
     p AS (SELECT draft, NULL AS page, 0 AS piece, text AS body FROM d UNION ALL SELECT draft, 4, 1, text FROM d UNION ALL SELECT draft, 5, 2, text FROM d)
SELECT draft, page::INT AS page, piece::INT AS piece, unnest(range(len(ss)))::INT AS position, unnest(ss) AS sentence
FROM (SELECT draft, page, piece, {SENTENCES_SQL.format(text="body")} AS ss FROM p)
""")
def w7_page_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.concat("text", F.lit("\n--- Page 4 ---\n"), "text", F.lit("\n--- Page 5 ---\n"), "text")
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("draft"), pages.alias("text"))
    return paged_sentences(docs, "draft", "text")


@query("""
SELECT o_custkey AS project_id, o_orderkey AS revision_id, row_number() OVER w AS version, lag(o_orderkey) OVER w AS previous, o_orderkey = first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def w8_version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions with their version, the one before, and which is newest."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderkey").alias("revision_id"),
        F.row_number().over(order).alias("version"),
        F.lag("o_orderkey").over(order).alias("previous"),
        F.lead("o_orderkey").over(order).isNull().alias("newest"),
    )


@query("""
SELECT o_orderkey AS claim, l_suppkey AS source, l_linenumber AS start FROM lineitem JOIN orders ON o_orderkey = l_orderkey
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC, l_discount, l_suppkey, l_linenumber) = 1
""")
def w9_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's best candidate: score, then the narrower, then source and start, by one aggregation."""
    rank = F.struct((-F.col("l_quantity")).alias("score"), "l_discount", "l_suppkey", "l_linenumber")
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(F.min(rank).alias("b"))
    return best.select("claim", F.col("b.l_suppkey").alias("source"), F.col("b.l_linenumber").alias("start"))


@query("""
SELECT l_orderkey AS document, 'issue-' || lpad(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber)::VARCHAR, 2, '0') AS id, l_linenumber AS was FROM lineitem
""")
def w10_issue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues numbered anew by severity, then by what they were."""
    severity = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(severity, "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.concat(F.lit("issue-"), F.lpad(place.cast("string"), 2, "0")).alias("id"), F.col("l_linenumber").alias("was"))


@query("""
SELECT conv_id, turn, lock_index, metric FROM (SELECT conv_id, turn, unnest(range(1, len(w) + 1))::INT AS lock_index, unnest(w) AS metric FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM conversations))
""")
def w11_lock_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's terms, numbered from 1."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("i", "metric"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).alias("lock_index"), "metric")


@query("""
SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3
""")
def l1_latest_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three rows of each project."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("place", place).where("place <= 3").select("user_id", "event_id", "ts")


@query("""
SELECT variation, score, usage FROM (SELECT p_brand || '/' || p_size AS variation, round(avg(p_retailprice), 4) AS score, count(*) AS usage FROM part GROUP BY 1)
ORDER BY score DESC, usage DESC, variation LIMIT 10
""")
def l2_best_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best variations by score, then use."""
    grouped = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_size").alias("variation")).agg(F.round(F.avg("p_retailprice"), 4).alias("score"), F.count("*").alias("usage"))
    return grouped.orderBy(F.desc("score"), F.desc("usage"), "variation").limit(10)
