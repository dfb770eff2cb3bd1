"""Files that a free text names by path or glob, as sections for a prompt."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import checkpoint_dir

#: The limits of a context made of files.
MAX_FILES = 20
MAX_FILE_BYTES = 200_000
MAX_TOTAL_BYTES = 500_000
HEAD_BYTES = 4096
TRUNCATED = "\n... [truncated]\n"


def named_paths(text: str | None) -> list[str]:
    """The words of a text that may be paths, in order, once each: behind ``@``, or with ``/`` or an extension; no URLs."""
    found: dict[str, None] = {}
    for word in re.split(r"[\s,]+", text or ""):
        word = word.strip("`'\"")
        path = word.removeprefix("@").rstrip("?!;:)") if not word.endswith("/*") else word.removeprefix("@")
        if path and "://" not in path and (word.startswith("@") or "/" in path or re.search(r"\w\.\w{1,8}$", path)):
            found[path] = None
    return list(found)


def _files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that exist under the paths and globs, once each, at most ``MAX_FILES``; folders aren't read."""
    # Only the names of a prompt's few files pass through the driver, by the file system that the path belongs to.
    context = spark.sparkContext
    found: dict[str, None] = {}
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        for status in where.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(where) or []:
            if status.isFile():
                found[status.getPath().toString()] = None
    return list(found)[:MAX_FILES]


def read_named(spark: SparkSession, text: str | None) -> DataFrame:
    """place, path and section of the files that ``text`` names; a section is the file's text fenced under its path.

    Files with a zero byte in their head are passed over, as are names of
    nothing. A file is cut at ``MAX_FILE_BYTES``; once files have
    ``MAX_TOTAL_BYTES`` together, the rest are named without their text.
    """
    files = _files(spark, named_paths(text))
    if not files:
        return spark.createDataFrame([], "place int, path string, section string")
    places = spark.createDataFrame(list(enumerate(files)), "place int, path string")
    head = F.substring("content", 1, MAX_FILE_BYTES)
    rows = spark.read.format("binaryFile").load(files).join(F.broadcast(places), "path")
    rows = rows.where(~F.contains(F.substring("content", 1, HEAD_BYTES), F.lit(b"\x00")))
    # At most MAX_FILES rows, so one running sum holds them.
    total = F.sum(F.least("length", F.lit(MAX_FILE_BYTES))).over(Window.orderBy("place"))
    cut = F.when(F.col("length") > MAX_FILE_BYTES, TRUNCATED).otherwise("")
    shown = rows.select("place", "path", total.alias("total"), F.rtrim(F.concat(F.decode(head, "UTF-8"), cut), F.lit(" \t\r\n")).alias("text"))
    fences = F.transform(F.regexp_extract_all("text", F.lit("`{3,}"), F.lit(0)), lambda run: F.length(run) + 1)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(fences), F.lit(3)))
    kind = F.regexp_extract("path", r"\.(\w+)$", 1)
    section = F.concat(F.lit("### File: "), "path", F.lit("\n"), fence, kind, F.lit("\n"), "text", F.lit("\n"), fence)
    skipped = F.concat(F.lit("### File: "), "path", F.lit("\nSkipped: the context is full."))
    return shown.select("place", "path", F.when(F.col("total") <= MAX_TOTAL_BYTES, section).otherwise(skipped).alias("section"))


@query("SELECT 0 AS place, string_agg(r_name, chr(10) ORDER BY r_name) AS text FROM region")
def s16_named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a file of region names that a prompt names by a glob."""
    folder = f"{checkpoint_dir(spark)}/named-{uuid.uuid4().hex}"
    table(spark, sf_dir, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(folder)
    named = read_named(spark, f"Which regions do the files @{folder}/*.txt list?")
    return named.select("place", F.regexp_extract("section", "(?s)```txt\n(.*)\n```$", 1).alias("text"))


@query("""
SELECT row_number() OVER (ORDER BY item_id::VARCHAR || '/') - 1 AS place, item_id, text FROM (
  SELECT item_id, text FROM benchmark WHERE item_id::VARCHAR LIKE '1%' ORDER BY item_id::VARCHAR || '/' LIMIT 20)
""")
def s16_named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in files of their own, of which a prompt names some by a glob: the first twenty, as a prompt's context holds."""
    folder = f"{checkpoint_dir(spark)}/named-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "benchmark").select("text", "item_id")
    rows.repartition("item_id").write.partitionBy("item_id").text(folder)
    named = read_named(spark, f"Compare what `{folder}/item_id=1*/*.txt` say, please.")
    item = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long")
    return named.select(F.col("place").cast("long").alias("place"), item.alias("item_id"), F.regexp_extract("section", "(?s)```txt\n(.*)\n```$", 1).alias("text"))
