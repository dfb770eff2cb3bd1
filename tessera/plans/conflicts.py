"""Disagreements: between sources, between runs, between findings; and the lineage of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import written


def source_conflicts(sources: DataFrame, project: str, key: str, text) -> DataFrame:
    """Pairs of fact sets of a project's sources that disagree in years or durations.

    Sources that state the same set are one class, named by its smallest
    member, and pairs are formed between classes, so many sources that agree
    give no pairs among themselves. Both sides must have something of their own.
    """
    facts = sources.select(project, key, F.explode(F.create_map(F.lit("year"), X.years(text), F.lit("duration"), X.durations(text))).alias("kind", "facts")).where("size(facts) > 0")
    classes = facts.groupBy(project, "kind", "facts").agg(F.min(key).alias("member"), F.count("*").alias("members"))
    a = classes.select(project, "kind", F.col("facts").alias("fa"), F.col("member").alias("source_a"), F.col("members").alias("members_a"))
    b = classes.select(project, "kind", F.col("facts").alias("fb"), F.col("member").alias("source_b"), F.col("members").alias("members_b"))
    pairs = a.join(b, [project, "kind"]).where("source_a < source_b")
    only = lambda x, y: F.array_join(F.slice(F.array_sort(F.array_except(x, y)), 1, 4), ", ")
    found = pairs.where((F.size(F.array_except("fa", "fb")) > 0) & (F.size(F.array_except("fb", "fa")) > 0))
    return found.select(project, "kind", "source_a", "source_b", "members_a", "members_b", only("fa", "fb").alias("only_a"), only("fb", "fa").alias("only_b"))


@query(r"""
WITH d AS (SELECT source, doc_id, text || ' Kept ' || doc_id % 9 || ' years since ' || (1990 + doc_id % 12) || ' or ' || (1990 + doc_id % 5) AS t FROM documents),
f AS (SELECT source, doc_id, 'year' AS kind, list_sort(list_distinct(regexp_extract_all(t, '\b((?:19|20)[0-9]{2})\b', 1))) AS facts FROM d
  UNION ALL SELECT source, doc_id, 'duration', list_sort(list_distinct(list_transform(regexp_extract_all(lower(t), '\b([0-9]+[\x20\x09-\x0D]+(?:years?|months?|days?|weeks?))\b', 1), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))) FROM d),
c AS (SELECT source, kind, facts, min(doc_id) AS member, count(*) AS members FROM f WHERE len(facts) > 0 GROUP BY 1, 2, 3),
p AS (SELECT a.source, a.kind, a.member AS source_a, b.member AS source_b, a.members AS members_a, b.members AS members_b, list_sort(list_filter(a.facts, lambda x: NOT list_contains(b.facts, x))) AS oa, list_sort(list_filter(b.facts, lambda x: NOT list_contains(a.facts, x))) AS ob
  FROM c a JOIN c b ON a.source = b.source AND a.kind = b.kind AND a.member < b.member)
SELECT source, kind, source_a, source_b, members_a, members_b, array_to_string(oa[1:4], ', ') AS only_a, array_to_string(ob[1:4], ', ') AS only_b FROM p WHERE len(oa) > 0 AND len(ob) > 0
""")
def v14_source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    t = F.concat("text", F.lit(" Kept "), k % 9, F.lit(" years since "), 1990 + k % 12, F.lit(" or "), 1990 + k % 5)
    return source_conflicts(table(spark, sf_dir, "documents"), "source", "doc_id", t)


def cross_run(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """For each metric with several values, its first entry and the first that differs; one row for each pair of runs."""
    entry = F.struct(*dict.fromkeys([*order, "run_id", "value"]))
    first = entries.groupBy(key).agg(F.min(entry).alias("a"))
    other = entries.join(first, key).where(F.col("value") != F.col("a.value")).groupBy(key).agg(F.min(entry).alias("b"), F.first("a").alias("a"))
    pairs = other.select(key, F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"), F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))
    best = Window.partitionBy("run_a", "run_b").orderBy(key)
    return pairs.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


@query("""
WITH e AS (SELECT l_partkey AS metric, l_orderkey AS run_id, l_linenumber AS line, l_quantity AS value FROM lineitem),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY metric ORDER BY run_id, line, value) = 1),
s AS (SELECT e.* FROM e JOIN f ON e.metric = f.metric AND e.value <> f.value QUALIFY row_number() OVER (PARTITION BY e.metric ORDER BY e.run_id, e.line, e.value) = 1),
p AS (SELECT f.metric, f.run_id AS run_a, s.run_id AS run_b, f.value AS value_a, s.value AS value_b FROM f JOIN s ON f.metric = s.metric)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY run_a, run_b ORDER BY metric) = 1
""")
def v15_cross_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("metric"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"))
    return cross_run(entries, "metric", ["run_id", "line"])


@query(r"""
WITH f AS (SELECT event_id, user_id, lower(event_type) AS title, regexp_replace(left(props, 240), '[\x20\x09-\x0D]+', ' ', 'g') AS content, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity FROM events),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, title, content ORDER BY event_id) = 1)
SELECT user_id, event_id, title, severity, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, event_id) AS place FROM d
""")
def v18_finding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without repeats of title and content, the severe ones first."""
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    found = table(spark, sf_dir, "events").select("user_id", "event_id", F.lower("event_type").alias("title"), F.regexp_replace(F.substring("props", 1, 240), r"[\x20\x09-\x0D]+", " ").alias("content"), severity.alias("severity"))
    kept = found.groupBy("user_id", "title", "content").agg(F.min(F.struct("event_id", "severity")).alias("f")).select("user_id", "title", "f.*")
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return kept.select("user_id", "event_id", "title", "severity", F.row_number().over(Window.partitionBy("user_id").orderBy(rank, "event_id")).alias("place"))


@query("""
WITH f AS (SELECT doc_id, 'dollar' AS category, 2 AS rank FROM documents WHERE contains(text, '$') UNION ALL SELECT doc_id, 'license', 1 FROM documents WHERE contains(lower(text), 'license')
  UNION ALL SELECT doc_id, 'secret', 0 FROM documents WHERE contains(text, 'token =') UNION ALL SELECT doc_id, 'shouting', 2 FROM documents WHERE contains(text, '!!'))
SELECT doc_id, 'issue-' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY rank, category)::VARCHAR, 2, '0') AS id, category FROM f
""")
def v16_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all rule scans of a document, from one pass over its text, numbered by severity."""
    text = F.col("text")
    rules = [("secret", 0, F.contains(text, F.lit("token ="))), ("license", 1, F.contains(F.lower(text), F.lit("license"))), ("dollar", 2, F.contains(text, F.lit("$"))), ("shouting", 2, F.contains(text, F.lit("!!")))]
    hits = F.array_compact(F.array(*[F.when(found, F.lit(name)) for name, _, found in rules]))
    issues = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(hits).alias("i", "category"))
    return issues.select("doc_id", F.concat(F.lit("issue-"), F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("id"), "category")


def ancestors(links: DataFrame) -> DataFrame:
    """All ancestors of each node of ``links`` (node, parent), with the depth at which each is met first.

    Pairs of the greatest depth so far meet all pairs, so each round reaches
    twice as far: of a shortest path of more than ``reach`` links the first
    ``reach`` are a shortest path too, and the rest is one that is known. So
    each pair is met once for each shortest path's node at that depth, not at
    every depth, and a cycle ends as nothing new is found. A recursive query
    would stop at its row limit.
    """
    found = written(links.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).where("ancestor IS NOT NULL").distinct())
    reach = 1
    while True:
        last = found.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        onward = found.select(F.col("node").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        longer = last.join(onward, "via").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        fresh = written(longer.join(found, ["node", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            return found
        found, reach = found.unionByName(fresh), 2 * reach


LINEAGE_SQL = """
WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
c AS (SELECT node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.node, e.parent, depth + 1 FROM c JOIN e ON e.node = c.ancestor)
SELECT node, ancestor, depth FROM c
"""


@query(LINEAGE_SQL)
def v24_lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each artifact over its links."""
    return ancestors(table(spark, sf_dir, "part").where("p_partkey > 0").selectExpr("p_partkey AS node", "p_partkey DIV 3 AS parent"))


@query(LINEAGE_SQL)
def v24_whole_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its second name."""
    return v24_lineage_closure(spark, sf_dir)


@query("""
SELECT p_partkey AS chunk, p_brand AS tenant, list_sort(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), ['red', 'green', 'part', '7'])) AS matched FROM part
WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), ['red', 'green', 'part', '7'])) > 0 AND p_brand <> 'Brand#11'
""")
def v22_chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of other tenants left out, those with any of the asked words, and which."""
    asked = F.array(*[F.lit(w) for w in ("red", "green", "part", "7")])
    matched = F.array_sort(F.array_intersect(F.array_distinct(X.words(F.col("p_name"))), asked))
    rows = table(spark, sf_dir, "part").where("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("chunk"), F.col("p_brand").alias("tenant"), matched.alias("matched"))
    return rows.where("size(matched) > 0")
