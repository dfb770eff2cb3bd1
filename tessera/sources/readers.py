"""Readers of texts, pages, parsed bundles and configurations."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.units import PIECE_CHARS, pieces
from tessera.operators.joins import host_policy
from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import checkpoint_dir

#: Extensions of files that are text as they are.
TEXT_EXTENSIONS = "txt md json csv rst yaml yml".split()
#: Elements whose text is not the page's.
SKIPPED = {
    "script", "style", "noscript", "template", "svg", "iframe",
    "nav", "footer", "header", "aside", "form", "button", "select", "option",
}
#: Elements that hold a page's main text.
MAIN = {"main", "article"}
MIN_PAGE_CHARS = 200


def read_texts(spark: SparkSession, paths: list[str], glob: str = "*") -> DataFrame:
    """path, name and text of whole files; bytes that are no UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def as_uploads(files: DataFrame) -> DataFrame:
    """``files`` (name, text) with parser, source_kind and page_count: text-like ones are taken whole, others go to another parser, without text."""
    routed = files.withColumn("parser", parser_of(F.col("name"), F.lit(None)))
    plain = F.col("parser") == "text"
    return routed.withColumn("source_kind", F.when(plain, "text")).withColumn("page_count", F.when(plain, 1)).withColumn("text", F.when(plain, F.col("text")))


@query("""
SELECT item_id, 'jdf' AS parser, NULL AS chars, NULL AS digest FROM benchmark WHERE item_id % 4 = 3
UNION ALL SELECT item_id, 'text', length(text) + 1, sha256(text || chr(10)) FROM benchmark WHERE item_id % 4 < 3
""")
def s4_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as files of several kinds to the shared folder, and read as uploads."""
    folder = f"{checkpoint_dir(spark)}/uploads-{uuid.uuid4().hex}"
    kinds = F.array(*[F.lit(k) for k in ("txt", "md", "yaml", "bin")])
    rows = table(spark, sf_dir, "benchmark").select("text", "item_id", F.element_at(kinds, (F.col("item_id") % 4 + 1).cast("int")).alias("kind"))
    # One file a passage; Spark names it, and the folder's name carries the upload's.
    rows.repartition("item_id").write.partitionBy("kind", "item_id").text(folder)
    files = read_texts(spark, [f"{folder}/*/*/*.txt"])
    found = files.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.concat(F.lit("upload."), F.regexp_extract("path", "kind=([a-z]+)", 1)).alias("name"), "text")
    return as_uploads(found).select("item_id", "parser", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file: a list, or an object with cases, items or tests."""
    rows = spark.read.option("multiLine", "true").json(path)
    for name in ("cases", "items", "tests"):
        if name in rows.columns:
            return rows.select(F.explode(name).alias("c")).select("c.*")
    return rows


def parser_of(name: Column, kind: Column) -> Column:
    """The parser that a file goes to: by its declared kind, else text extensions, else PDF, else the default."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(F.coalesce(kind, F.lit("")) != "", kind).when(extension.isin(TEXT_EXTENSIONS), "text").when(extension == "pdf", "pdf_text").otherwise("jdf")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'scan' WHEN p_partkey % 10 IN (1, 2, 3) THEN 'text' WHEN p_partkey % 10 = 4 THEN 'pdf_text' ELSE 'jdf' END AS parser FROM part
""")
def s5_parser_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("a.bin", "a.txt", "b.MD", "c.yaml", "d.PDF", "e", "f.doc", "g.", "h.x", "i.jpeg")]), (key % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", parser_of(name, F.when(key % 10 == 0, "scan")).alias("parser"))


@query("""
SELECT l_orderkey AS document, count(*) AS chunks, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS tables, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS images, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS figures FROM lineitem GROUP BY 1
""")
def s7_chunk_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, images and figures of a document's chunks by their types; a chunk may be several."""
    kinds = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "Table"), F.when(F.col("l_returnflag") == "A", "image"), F.when(F.col("l_linestatus") == "F", "FIGURE")))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.transform(kinds, F.lower).alias("types"))
    count = lambda kind: F.count(F.when(F.array_contains("types", kind), 1)).alias(f"{kind}s")
    return chunks.groupBy("document").agg(F.count("*").alias("chunks"), count("table"), count("image"), count("figure"))


@query("""
SELECT o_orderkey AS page, round(avg(CASE WHEN l_discount > 0.01 THEN l_tax END), 6) AS confidence, count(CASE WHEN l_discount > 0.01 THEN l_tax END) AS blocks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def s8_ocr_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence over the blocks of a page that report one; null where none does."""
    block = F.struct(F.when(F.col("l_discount") > 0.01, F.col("l_tax")).alias("confidence"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(block).alias("blocks"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")).join(lines, "page", "left")
    each = pages.select("page", F.explode_outer("blocks").alias("b"))
    return each.groupBy("page").agg(F.round(F.avg("b.confidence"), 6).alias("confidence"), F.count("b.confidence").alias("blocks"))


#: One piece of a page: a comment or declaration, an element of raw text whole, or a tag.
_PIECE = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<name>[a-z][a-z0-9-]*)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", re.S | re.I)


def _texts(html: str) -> Iterator[tuple[str, str]]:
    """The runs of text that are shown, each as part of the title, of a main part or of the rest.

    Only how many skipped and main elements are open is kept, so a page is
    read in time linear in its length, however many tags stay open. An end tag
    closes one element of its sort; without an open one it counts for nothing.
    """
    skipped = main = 0
    titled = False
    at = 0
    for piece in _PIECE.finditer(html):
        if titled or not skipped:
            yield "title" if titled else "main" if main else "rest", html[at : piece.start()]
        at = piece.end()
        name = (piece["name"] or "").lower()
        ways = [] if not name else [-1] if piece["end"] else [1, -1] if piece[0].endswith("/>") else [1]
        for way in ways:
            if name == "title":
                titled = way > 0
            elif name in SKIPPED:
                skipped = max(0, skipped + way)
            elif name in MAIN:
                main = max(0, main + way)
    if titled or not skipped:
        yield "title" if titled else "main" if main else "rest", html[at:]


def page_text(html: str | None) -> tuple[str, str]:
    """A page's title and text: that of its main parts if it is long enough, else all that is shown.

    The text keeps its lines; white space in a line is one space, and blank
    lines go.
    """
    runs = [(part, unescape(run)) for part, run in _texts(html or "")]
    title = " ".join(" ".join(run for part, run in runs if part == "title").split())
    shown = [(part, run.strip()) for part, run in runs if part != "title" and run.strip()]
    main = " ".join(run for part, run in shown if part == "main")
    chosen = main if len(main) >= MIN_PAGE_CHARS else " ".join(run for _, run in shown)
    lines = (" ".join(line.split()) for line in unescape(chosen).splitlines())
    return title, "\n".join(line for line in lines if line)


def main_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title and text of each page."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, title string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, pc.utf8_length(whole.column(1)).to_pylist(), PIECE_CHARS)):
            found = [page_text(h.as_py()) for h in batch.column(1)]
            columns = [pa.array(x, pa.string()) for x in ([t for t, _ in found], [x for _, x in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "title", "text"])

    return pages.select(key, html).mapInArrow(run, schema)


@query()
def s10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), "page_id", "html")


@query(r"""
WITH h AS (SELECT page_id, page_id % 50 AS question, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages),
d AS (SELECT *, starts_with(url, 'https://') AND (ends_with(host, '.example.com') OR ends_with(host, '.example.org')) AS ok FROM h),
r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY question ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT question, page_id, ok FROM r WHERE coalesce(before, 0) < 3
""")
def s19_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in their order, until three are accepted; rejected ones before that are listed as such."""
    pages = table(spark, sf_dir, "pages")
    decided = host_policy(pages, ("example.com", "example.org"), ()).select("page_id", (F.col("decision") == "allowed").alias("ok"))
    rows = pages.select("page_id", (F.col("page_id") % 50).alias("question")).join(decided, "page_id")
    ahead = Window.partitionBy("question").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(F.col("ok").cast("int")).over(ahead), F.lit(0))).where("before < 3").select("question", "page_id", "ok")


@query("""
SELECT s_suppkey AS config, k AS key, k || ': ' || v AS paragraph FROM (SELECT s_suppkey, unnest(['name', 'nation']) AS k, unnest([s_name, s_nationkey::VARCHAR]) AS v FROM supplier)
""")
def s21_config_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration's keys as paragraphs of a section."""
    config = F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("config"), F.explode(config).alias("key", "value"))
    return rows.select("config", "key", F.concat_ws(": ", "key", "value").alias("paragraph"))


@query("SELECT doc_id, source, n_chars, CASE WHEN regexp_matches(lower(text), 'system prompt|act as') THEN 'untrusted' ELSE 'trusted' END AS trust FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY doc_id DESC")
def s1_vault_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included sources, newest first, scanned anew for orders instead of trusting a stored flag."""
    included = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").join(included, "doc_id", "left_semi")
    trust = F.when(F.lower("text").rlike("system prompt|act as"), "untrusted").otherwise("trusted")
    return docs.select("doc_id", "source", "n_chars", trust.alias("trust")).orderBy(F.desc("doc_id"))
