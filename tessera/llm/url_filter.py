"""Judging URLs by host and path rules.

Each distinct host and path is expanded into the expressions that a rule could
have: its host's suffixes at dots, in the numbers of labels that rules have,
times its path's prefixes, in the lengths that rules have. Expressions and
rules meet in an equi-join on the first digits of their SHA-256; the whole
digest then confirms the match, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded, read, stored

SHORT_DIGITS = 8
MAX_BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the query: verdict, host, path.
QUERY_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def _expressions(labels: int, prefixes: list[int]) -> Column:
    """The host's last ``labels`` labels with each of the path's prefixes of those lengths; none for shorter hosts."""
    suffix = F.substring_index("host", ".", -labels)
    fitting = F.filter(F.array(*[F.lit(n) for n in prefixes]), lambda n: n <= F.length("path"))
    made = F.transform(fitting, lambda n: F.concat_ws("\n", suffix, F.col("path").substr(F.lit(1), n)))
    return F.when(F.size(F.split("host", r"\.")) >= labels, made).otherwise(F.array().cast("array<string>"))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns of each row with host, path, rule and verdict.

    ``rules`` has verdict, rule_host and rule_path. A rule fits its host and
    all subdomains when the path starts with the rule's. The longest
    expression wins, of equally long ones that with the longer host, of equal
    ones the blocking one. Without a rule the verdict is ``default`` and rule
    null. Other columns are ignored, whatever their names, and a URL of any
    length is judged whole. Null URLs and such without ``://`` have an empty host and path and
    fit no rule, but one with an empty host. Repeated rows are judged alike;
    no rules or no URLs give defaults or no rows; rules with a null host or
    path fit nothing.
    """
    host, path = host_and_path(F.col(url_col))
    pages = urls.select(*[F.col(c) for c in keep], host.alias("host"), path.alias("path"))
    known = stored(
        rules.where("rule_host is not null and rule_path is not null").select(
            F.concat("rule_host", "rule_path").alias("rule"),
            F.col("verdict"),
            F.length("rule_host").alias("host_length"),
            F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"),
            F.size(F.split("rule_host", r"\.")).alias("labels"),
            F.length("rule_path").alias("prefix"),
        )
    )
    # The shapes that rules have: as many as there are pairs of a label count and a path length.
    shapes = known.groupBy("labels").agg(F.collect_set("prefix").alias("prefixes"))
    shape_rows = [(r.labels, sorted(r.prefixes)) for r in shapes.collect()]
    expressions = [_expressions(labels, prefixes) for labels, prefixes in shape_rows]
    places = pages.select("host", "path").distinct()
    expanded = places.select("host", "path", F.explode(F.concat(F.array().cast("array<string>"), *expressions)).alias("expression")).select(
        "host", "path", F.sha2("expression", 256).alias("digest")
    )
    table = known.withColumn("short", F.substring("rule_digest", 1, SHORT_DIGITS))
    met = expanded.withColumn("short", F.substring("digest", 1, SHORT_DIGITS)).join(bounded(table, MAX_BROADCAST_RULES), "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule").alias("length"), "host_length", (F.col("verdict") == "block").alias("blocks"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        *keep,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), rules_frame(spark, QUERY_RULES))


OP6_SQL = r"""
WITH rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), m AS (
  SELECT d.host, d.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) d
  JOIN rules ON (d.host = rule_host OR ends_with(d.host, '.' || rule_host)) AND starts_with(d.path, rule_path)
  GROUP BY ALL
)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
