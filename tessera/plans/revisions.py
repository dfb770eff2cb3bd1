"""Revisions compared: by lines, by the span that changed, by the structure that was added."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.diffs import STRUCTURE_WORDS, STRUCTURES, changed_spans, format_drift, structure_counts, unified_diff, with_edges
from tessera.functions.sql import quoted
from tessera.registry import query
from tessera.sources.tables import table


def _diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [unified_diff(left or "", right or "", f"{a} (reply)", f"{b} (reply)") for a, b, left, right in zip(*(batch.column(n).to_pylist() for n in ("left_id", "right_id", "left", "right")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["left_id", "right_id", "diff"])


def line_diffs(pairs: DataFrame) -> DataFrame:
    """left_id, right_id and diff of ``pairs`` (left_id, right_id, left, right): hunks of the fewest changed lines, empty for equal texts; null texts are empty."""
    named = pairs.select(F.col("left_id").cast("string"), F.col("right_id").cast("string"), "left", "right")
    return named.mapInArrow(_diffs, "left_id string, right_id string, diff string")


def following_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(order).alias("before"))
    return turns.where("before IS NOT NULL")


@query()
def t24_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with a sentence a line, compared with a revision in which some sentences changed."""
    lines = F.regexp_replace("text", r"(?<=[.!?])\s+", "\n")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("left_id"), lines.alias("left"))
    return line_diffs(rows.select("left_id", F.concat("left_id", F.lit("r")).alias("right_id"), "left", F.regexp_replace("left", r"\b[Tt]he [^.!?\n]*", "that").alias("right")))


_PAIRS = "p AS (SELECT * FROM (SELECT conv_id, turn, text AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS a FROM conversations) WHERE a IS NOT NULL)"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
WITH {_PAIRS},
q AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[:i] = b[:i])) AS n FROM p),
r AS (SELECT conv_id, turn, a[n + 1:] AS x, b[n + 1:] AS y FROM q),
s AS (SELECT *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: reverse(x)[:i] = reverse(y)[:i])) AS m FROM r),
t AS (SELECT conv_id, turn, trim(x[:length(x) - m], {_BLANK}) AS a_text, trim(y[:length(y) - m], {_BLANK}) AS b_text FROM s)
SELECT * FROM t WHERE a_text <> '' OR b_text <> ''
""")
def t24_changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn holds in place of the one before it, between what they share at both ends."""
    spans = F.array_compact(F.array(changed_spans(F.col("before"), F.col("text"))))
    # Exploded, so that the columns are read of what was computed once.
    return following_turns(spark, sf_dir).select("conv_id", "turn", F.explode(spans).alias("s")).select("conv_id", "turn", "s.a_text", "s.b_text")


def _count_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_DRIFT = ", ".join(
    f"CASE WHEN {_count_sql('o', p)} <> {_count_sql('r', p)} THEN CASE WHEN {_count_sql('r', p)} > {_count_sql('o', p)} THEN 'added' ELSE 'removed' END || ' {name} (' || {_count_sql('o', p)} || ' -> ' || {_count_sql('r', p)} || ') without being asked' END"
    for name, p in STRUCTURES.items()
)


@query(rf"""
WITH d AS (SELECT doc_id, text AS o, CASE doc_id % 4 WHEN 0 THEN '# Head' || chr(10) || text WHEN 1 THEN regexp_replace(text, '([.!?])\s+', '\1' || chr(10) || '- ', 'g') WHEN 2 THEN text || ' **bold**' ELSE text END AS r,
  CASE WHEN doc_id % 5 = 0 THEN 'Use a numbered ' || lang ELSE source END AS instruction FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(list_filter([{quoted(STRUCTURE_WORDS)}], lambda w: contains(lower(instruction), w))) > 0 THEN [] ELSE list_filter([{_DRIFT}], lambda x: x IS NOT NULL) END AS reasons,
  {", ".join(f"{_count_sql('r', p)} AS {name}" for name, p in STRUCTURES.items())} FROM d
""")
def t24_format_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure that revisions of documents add or take away unasked."""
    text, kind = F.col("text"), F.col("doc_id") % 4
    listed = F.regexp_replace(text, r"([.!?])\s+", "$1\n- ")
    revised = F.when(kind == 0, F.concat(F.lit("# Head\n"), text)).when(kind == 1, listed).when(kind == 2, F.concat(text, F.lit(" **bold**"))).otherwise(text)
    asked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Use a numbered "), "lang")).otherwise(F.col("source"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", revised.alias("revised"), asked.alias("asked"))
    counts = [c.cast("long").alias(name) for name, c in structure_counts(F.col("revised")).items()]
    return rows.select("doc_id", format_drift(F.col("text"), F.col("revised"), F.col("asked")).alias("reasons"), *counts)


@query(f"""
WITH {_PAIRS},
e AS (SELECT conv_id, turn, ' ' || chr(10) || a || chr(9) AS o, b FROM p),
f AS (SELECT *, trim(o, {_BLANK}) AS body FROM e)
SELECT conv_id, turn, sha256(CASE WHEN body = '' THEN o || trim(b, {_BLANK}) ELSE o[:strpos(o, body[1]) - 1] || trim(b, {_BLANK}) || o[strpos(o, body[1]) + length(body):] END) AS kept FROM f
""")
def t24_kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns put in place of the ones before them, between the white space those had around them."""
    original = F.concat(F.lit(" \n"), "before", F.lit("\t"))
    return following_turns(spark, sf_dir).select("conv_id", "turn", F.sha2(with_edges(original, F.col("text")), 256).alias("kept"))
