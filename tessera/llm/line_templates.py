"""Dropping recurring lines by a log-template tree of fixed depth.

A line's tokens with digits are variable fields, written ``<*>``. The tree's
levels are the number of tokens and the first ``LEADING`` tokens; a leaf's
lines agree in those. Within a leaf a token that fewer than ``min_docs`` lines
have at its position is a variable field too. What remains is the line's
template; a template of which at least half the tokens are fixed, and that
recurs in ``min_docs`` documents, is dropped wherever it stands. A line as it
stands is a template too: it goes when it recurs in ``min_docs`` documents,
or, with more than ``LONG_WORDS`` tokens, in two documents of different text.

A template cannot recur in more documents than its leaf has lines, so leaves
are counted first, by a hash, and only lines of leaves that recur are looked
into. Each distinct line (a kind) is then one row with its number of documents,
and a leaf's kinds meet in one partition, where its tokens are counted without
another shuffle. Leaves with a large share of all kinds are counted by token
over all partitions instead. Leaves, lines and templates are told apart by two
64-bit hashes at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD_CLASS, bounded, read, shuffle_partitions, stored, whole

MIN_DOCS = 5
LONG_WORDS = 50
LEADING = 2
VARIABLE = "<*>"
#: Leaves of 8 bytes and lines of 24 bytes that are broadcast at most.
MAX_BROADCAST_ROWS = 500_000
#: A leaf or line with more than 1 / (HOT_SHARE * partitions) of all kinds or documents is hot: there are at most HOT_SHARE * partitions.
HOT_SHARE = 8
LEAST_HOT = 1_000
SALTS = 16

_ODD_SPACE = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
_WITH_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def _lines(texts: DataFrame) -> DataFrame:
    """r1, r2, at, plain, masked, size and leaf of each line that has tokens."""
    each = texts.select("r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(WORD_CLASS))
    single = each.select("r1", "r2", "at", F.trim(F.regexp_replace("line", _ODD_SPACE, " ")).alias("plain"))
    masked = F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", _WITH_DIGIT, VARIABLE)).otherwise(F.col("plain"))
    sized = single.withColumn("masked", masked).withColumn("size", F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    return sized.withColumn("leaf", F.xxhash64("size", F.substring_index("masked", " ", LEADING)))


def _held_lines(texts: DataFrame, min_docs: int) -> DataFrame:
    """Lines of leaves that recur, with a key (k1, k2) of the masked line and one (v1, v2) of the line as it stands where that differs."""
    lines = _lines(texts)
    enough = (F.col("n") >= min_docs) | ((F.col("size") > LONG_WORDS) & (F.col("n") >= 2))
    busy = stored(lines.groupBy("leaf", "size").agg(F.count("*").alias("n")).where(enough).select("leaf").distinct())
    # Sound without the filter too, so a table too large to broadcast is left out.
    if busy.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        lines = lines.join(F.broadcast(busy), "leaf", "left_semi")
    own = F.col("plain") != F.col("masked")
    return stored(
        lines.select(
            "r1", "r2", "at", "leaf", "size", "masked",
            F.xxhash64("masked").alias("k1"),
            F.xxhash64(F.lit(2), "masked").alias("k2"),
            F.when(own, F.xxhash64(F.lit(3), "plain")).alias("v1"),
            F.when(own, F.xxhash64(F.lit(4), "plain")).alias("v2"),
        )
    )


def _kinds(held: DataFrame) -> DataFrame:
    """Each distinct line by its key: size, own (it is a line as it stands), general (masked), n documents, and whether their texts differ."""
    masked = held.select("leaf", "k1", "k2", "size", F.col("v1").isNull().alias("own"), F.lit(True).alias("general"), "r1", "r2")
    plain = held.where("v1 is not null").select("leaf", F.col("v1").alias("k1"), F.col("v2").alias("k2"), "size", F.lit(True).alias("own"), F.lit(False).alias("general"), "r1", "r2")
    key = ["leaf", "k1", "k2", "size", "own", "general"]
    return masked.unionByName(plain).distinct().groupBy(key).agg(F.count("*").alias("n"), (F.min("r2") != F.max("r2")).alias("differ"))


def _hashes(place: Column, token: Column) -> list[Column]:
    return [F.xxhash64(place, token).alias("h1"), F.xxhash64(F.lit(5), place, token).alias("h2")]


def _templates(kinds: DataFrame, held: DataFrame, min_docs: int) -> DataFrame:
    """leaf, k1, k2, n and the template (t1, t2) of each masked line whose template has enough fixed tokens."""
    spark = kinds.sparkSession
    parts = shuffle_partitions(spark)
    texts = held.groupBy("leaf", "k1", "k2").agg(F.first("masked").alias("masked"))
    shown = kinds.where("general").select("leaf", "k1", "k2", "size", "n").join(texts, ["leaf", "k1", "k2"])
    per_leaf = stored(kinds.where("general").groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= min_docs))
    hot_kinds = max(LEAST_HOT, (per_leaf.agg(F.sum("kinds")).first()[0] or 0) // (HOT_SHARE * parts))
    hot = per_leaf.where(F.col("kinds") > hot_kinds).select("leaf")

    def tokens(rows: DataFrame) -> DataFrame:
        """Tokens after the leading ones, whose support is the leaf's."""
        split = rows.select("leaf", "k1", "k2", "size", "n", F.split("masked", " ").alias("tokens"))
        lead = F.size(F.filter(F.slice("tokens", 1, LEADING), lambda t: t != VARIABLE))
        rest = F.when(F.col("size") > LEADING, F.slice("tokens", LEADING + 1, F.greatest(F.col("size"), F.lit(1)))).otherwise(F.array(F.lit(VARIABLE)))
        each = split.select("leaf", "k1", "k2", "size", "n", lead.alias("lead"), F.posexplode(rest).alias("place", "token"))
        return each.select("leaf", "k1", "k2", "size", "n", "lead", (F.col("token") == VARIABLE).alias("variable"), *_hashes(F.col("place"), F.col("token")))

    def summed(rows: DataFrame) -> DataFrame:
        """rows: tokens with ``support``. The template's hash is the fixed tokens' hashes put together; their places are part of those."""
        fixed = ~F.col("variable") & (F.col("support") >= min_docs)
        made = rows.groupBy("leaf", "k1", "k2", "size", "n", "lead").agg(
            F.count(F.when(fixed, 1)).alias("fixed"), F.bit_xor(F.when(fixed, F.col("h1"))).alias("t1"), F.bit_xor(F.when(fixed, F.col("h2"))).alias("t2")
        )
        firm = (F.col("lead") + F.col("fixed")) * 2 >= F.col("size")
        return made.where(firm).select("leaf", "k1", "k2", "n", F.coalesce("t1", F.lit(0)).alias("t1"), F.coalesce("t2", F.lit(0)).alias("t2"))

    # One shuffle by leaf serves everything here: all keys contain the leaf.
    leaf = Window.partitionBy("leaf")
    cold = shown.join(F.broadcast(hot), "leaf", "left_anti").repartition(parts, "leaf").withColumn("total", F.sum("n").over(leaf)).where(F.col("total") >= min_docs)
    found = summed(tokens(cold).withColumn("support", F.sum("n").over(Window.partitionBy("leaf", "h1", "h2"))))
    if not hot.isEmpty():
        each = tokens(shown.join(F.broadcast(hot), "leaf", "left_semi"))
        support = each.where("not variable").groupBy("leaf", "h1", "h2").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs)
        # A token that most lines of the leaf have is dealt over salts.
        salted = support.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted, ["leaf", "h1", "h2", "salt"], "left")
        found = found.unionByName(summed(met.withColumn("support", F.coalesce("support", F.lit(0)))))
    return stored(found)


def _bad_lines(held: DataFrame, min_docs: int) -> DataFrame:
    """leaf, k1, k2 and n of the lines to drop."""
    kinds = stored(_kinds(held))
    templates = _templates(kinds, held, min_docs)
    key = ["leaf", "t1", "t2"]
    per_template = templates.groupBy(key).agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    settled = per_template.where(F.col("most") >= min_docs)
    # Where no single line recurs enough, the template's documents are counted; each of its lines has few.
    open_ = templates.join(per_template.where((F.col("most") < min_docs) & (F.col("total") >= min_docs)), key).select("leaf", "k1", "k2", "t1", "t2")
    rare = held.select("leaf", "k1", "k2", "r1", "r2").join(kinds.where(F.col("general") & (F.col("n") >= min_docs)).select("leaf", "k1", "k2").transform(_broadcast_or_not), ["leaf", "k1", "k2"], "left_anti")
    documents = rare.join(open_, ["leaf", "k1", "k2"]).select(*key, "r1", "r2").distinct()
    counted = documents.groupBy(key).agg(F.count("*").alias("documents")).where(F.col("documents") >= min_docs)
    general = templates.join(settled.select(*key).unionByName(counted.select(*key)), key, "left_semi").select("leaf", "k1", "k2", "n")
    verbatim = kinds.where(F.col("own") & ((F.col("n") >= min_docs) | (F.col("differ") & (F.col("size") > LONG_WORDS))))
    return stored(general.unionByName(verbatim.select("leaf", "k1", "k2", "n")).groupBy("leaf", "k1", "k2").agg(F.max("n").alias("n")))


def _broadcast_or_not(keys: DataFrame) -> DataFrame:
    return bounded(stored(keys), MAX_BROADCAST_ROWS)


def _dropped_places(held: DataFrame, bad: DataFrame, documents: int) -> DataFrame:
    """r1, r2 and the set of places of lines to drop."""
    masked = held.select("r1", "r2", "at", "leaf", "k1", "k2")
    plain = held.where("v1 is not null").select("r1", "r2", "at", "leaf", F.col("v1").alias("k1"), F.col("v2").alias("k2"))
    rows = masked.unionByName(plain)
    key = ["leaf", "k1", "k2"]
    if bad.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        hit = rows.join(F.broadcast(bad.select(*key)), key, "left_semi")
    else:
        # Lines of very many documents meet their rows by broadcast, the others by a shuffle.
        limit = max(LEAST_HOT, documents // (HOT_SHARE * shuffle_partitions(held.sparkSession)))
        hot = stored(bad.where(F.col("n") > limit).select(*key))
        cold = rows.join(F.broadcast(hot), key, "left_anti").join(bad.where(F.col("n") <= limit).select(*key), key, "left_semi")
        hit = rows.join(F.broadcast(hot), key, "left_semi").unionByName(cold)
    return hit.groupBy("r1", "r2").agg(F.collect_set("at").alias("dropped"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text without its recurring lines, n_lines, n_dropped.

    Lines end at line feeds. Lines without tokens belong to no template and
    stay. A line that repeats within one document only does not recur. A null
    text counts as empty, one line without tokens. Documents are told apart by
    id and text, so rows that repeat in full count as one document and are
    all returned; null ids are an id like any other. Documents of one text
    count once for the rule of long lines, so copies alone lose no long line.
    No rows give no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    texts = texts.select("id", "text", F.xxhash64(F.col("id").isNull(), "id").alias("r1"), F.xxhash64(F.lit(1), "text").alias("r2"))
    held = _held_lines(texts, min_docs)
    dropped = _dropped_places(held, _bad_lines(held, min_docs), docs.count())
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped")
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return texts.join(dropped, ["r1", "r2"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rest).alias(text_col),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = recurring_lines(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, text, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d
), t AS (
  SELECT doc_id, text, pos, array_to_string(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ') AS own,
         list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''),
                        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS tokens
  FROM l
), h AS (
  SELECT *, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:2], ' ') AS leaf, array_to_string(tokens, ' ') AS line
  FROM t WHERE len(tokens) > 0
), k AS (
  SELECT leaf, line, tokens, count(DISTINCT (doc_id, text)) AS n FROM h GROUP BY leaf, line, tokens
), p AS (
  SELECT leaf, line, n, unnest(range(len(tokens))) AS place, unnest(tokens) AS token FROM k
), f AS (
  SELECT leaf, place, token FROM p WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(n) >= 5
), s AS (
  SELECT leaf, line, list(CASE WHEN f.token IS NOT NULL THEN p.token ELSE '<*>' END ORDER BY place) AS parts
  FROM p LEFT JOIN f USING (leaf, place, token) GROUP BY leaf, line
), m AS (
  SELECT leaf, line, array_to_string(parts, ' ') AS template FROM s
  WHERE len(list_filter(parts, lambda x: x <> '<*>')) * 2 >= len(parts)
), r AS (
  SELECT leaf, template FROM h JOIN m USING (leaf, line) GROUP BY leaf, template HAVING count(DISTINCT (doc_id, text)) >= 5
), o AS (
  SELECT own FROM h GROUP BY own HAVING count(DISTINCT (doc_id, text)) >= 5 OR (any_value(len(tokens)) > 50 AND count(DISTINCT text) >= 2)
), b AS (
  SELECT h.doc_id, h.text, h.pos FROM h JOIN m USING (leaf, line) JOIN r USING (leaf, template)
  UNION SELECT h.doc_id, h.text, h.pos FROM h JOIN o USING (own)
), c AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(b.pos) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (b.pos IS NULL), '') AS clean
  FROM l LEFT JOIN b ON l.doc_id IS NOT DISTINCT FROM b.doc_id AND l.text = b.text AND l.pos = b.pos
  GROUP BY l.doc_id, l.text
)
SELECT doc_id, n_lines, n_dropped, length(clean) AS n_chars, sha256(clean) AS text_sha256 FROM c
"""
