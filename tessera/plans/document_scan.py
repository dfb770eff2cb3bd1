"""A document's scan: four rules over the nodes of its tree and its ledger, without repeats, numbered by severity.

Nodes are rows: document_id, node_id, position, type, text, entities, cited,
pills, z3 and redhat (arrays of status and message). The ledger has a row for
each key of a document. Each rule gives issues with the place where a reader of
the document meets them; of equal category, description and node the first one
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import all_matches
from tessera.registry import query
from tessera.sources.tables import table

#: Patterns of metrics, amounts and lock tokens, and the names of magnitudes.
METRIC = r"([a-zA-Z_][\w.-]*)\s*(?:=|:)\s*\$?\s*(\d+(?:\.\d+)?)\s*([MBKmbk])?"
DOLLARS = r"\$\s*([\d,]+(?:\.\d+)?)(\s?(?:bn|billion|million|thousand|trillion|[KMBTkmbt])(?![A-Za-z]))?"
LOCK_TOKEN = r"\[🔒 #\d+\]"
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "trillion": 1e12}
SEVERE = ["hallucin", "unsupported", "contradict"]
SNIPPET = 120
#: A task puts the issues of about so many nodes in order.
NODES_A_TASK = 250_000

_RANKS = ["high", "medium", "low"]


def _scale(suffix: Column) -> Column:
    found = F.lit(1.0)
    for name, size in MAGNITUDES.items():
        found = F.when(F.lower(F.trim(suffix)) == name, size).otherwise(found)
    return found


def _matches(text: Column, pattern: str, *groups: int) -> Column:
    """The matches' groups as an array of structs ``g0``, ``g1``, …"""
    return F.arrays_zip(*[all_matches(text, pattern, g).alias(f"g{n}") for n, g in enumerate(groups)])


def metrics(text: Column) -> Column:
    """key and value of each ``key = 1.5M`` of a text, in order."""
    return F.transform(_matches(text, METRIC, 1, 2, 3), lambda m: F.struct(m["g0"].alias("key"), (m["g1"].cast("double") * _scale(m["g2"])).alias("value")))


def dollar_claims(text: Column) -> Column:
    """value and words of each amount of dollars, magnitudes counted in; figures of commas alone are none."""
    found = F.filter(_matches(text, DOLLARS, 0, 1, 2), lambda m: m["g1"].rlike("[0-9]"))
    return F.transform(found, lambda m: F.struct((F.replace(m["g1"], F.lit(","), F.lit("")).cast("double") * _scale(m["g2"])).alias("value"), F.regexp_replace(F.trim(m["g0"]), r"\s+", " ").alias("words")))


def shown(number: Column) -> Column:
    """A number with its point, whole ones too."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e16)
    return F.when(whole, F.concat(number.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))


def label(key: Column) -> Column:
    """A key for readers: blanks for underscores, each run of letters with a capital."""
    runs = F.regexp_extract_all(F.trim(F.replace(key, F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    named = F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
    return F.when(named == "", "baseline").otherwise(named)


def _issues(rows: DataFrame, rule: int, severity: Column, category: str, description: Column, *, node: Column | None = None, place: Column | None = None, order: Column | None = None) -> DataFrame:
    """Issues of a rule, in order of the node's place and then of ``order`` in it."""
    return rows.select(
        "document_id",
        F.struct(F.lit(rule).alias("rule"), (F.lit(-1) if place is None else place).cast("long").alias("place"), (F.lit(0) if order is None else order).cast("long").alias("order")).alias("at"),
        severity.alias("severity"),
        F.lit(category).alias("category"),
        F.trim(description).alias("description"),
        (F.lit(None).cast("string") if node is None else node.cast("string")).alias("node_id"),
    ).where("description <> ''")


def _contradiction(value: Column) -> Column:
    return F.concat(F.lit("Metric '"), F.col("key"), F.lit("'="), shown(value), F.lit(" contradicts locked == "), shown(F.col("locked")))


def dealt(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows by document, or by the keys, in so many parts. Grouping and joins take no more memory then than a part needs; before a shuffle a task would sort all that it reads."""
    return rows.repartition(parts, *(keys or ("document_id",)))


def ledger_issues(nodes: DataFrame, ledger: DataFrame, parts: int) -> DataFrame:
    """The first metric of the whole document that contradicts its ledger, each node's first one, and violations noted on nodes.

    Metrics are read from the texts put together, since one may span two nodes.
    Of a key that a node states twice the last value counts; a node is asked
    for the keys that it refers to, in its order.
    """
    keys = ["document_id", "key"]
    locks = dealt(ledger.select("document_id", F.trim("key").alias("key"), F.col("value").alias("locked")), parts, *keys)
    full = dealt(nodes.where(F.trim("text") != "").select("document_id", "position", "text"), parts).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda n: n["text"]), "\n\n").alias("text"))
    told = full.select("document_id", F.posexplode(metrics(F.col("text"))).alias("at", "m")).select("document_id", "at", "m.*")
    wrong = dealt(told, parts, *keys).join(locks, keys).where("value <> locked")
    first = dealt(wrong, parts).groupBy("document_id").agg(F.min_by(F.struct("key", "value", "locked"), "at").alias("w")).select("document_id", "w.*")

    stated = nodes.where("node_id <> ''").select("document_id", "node_id", "position", "entities", F.posexplode(metrics(F.col("text"))).alias("at", "m"))
    last = dealt(stated, parts).groupBy("document_id", "node_id", "position", "entities", F.col("m.key").alias("key")).agg(F.max_by("m.value", "at").alias("value"))
    asked = dealt(last.withColumn("asked", F.array_position("entities", F.col("key"))).where("asked > 0"), parts, *keys).join(locks, keys).where("value <> locked")
    node = dealt(asked, parts).groupBy("document_id", "node_id", "position").agg(F.min_by(F.struct("key", "value", "locked"), "asked").alias("w")).select("document_id", "node_id", "position", "w.*")

    noted = nodes.select("document_id", "node_id", "position", F.posexplode("z3").alias("i", "n")).where("n.status = 'violation'")
    message = F.coalesce(F.when(F.col("n.message") != "", F.col("n.message")), F.lit("Z3 constraint violation"))
    high, category = F.lit("high"), "Z3 Contradiction"
    return (
        _issues(first, 0, high, category, _contradiction(F.col("value")))
        .unionByName(_issues(node, 1, high, category, _contradiction(F.col("value")), node=F.col("node_id"), place=F.col("position"), order=F.lit(-1)))
        .unionByName(_issues(noted, 1, high, category, message, node=F.col("node_id"), place=F.col("position"), order=F.col("i")))
    )


def finding_issues(nodes: DataFrame) -> DataFrame:
    """Open findings noted on nodes; grave words make them severe."""
    noted = nodes.select("document_id", "node_id", "position", F.posexplode("redhat").alias("i", "n")).where(F.coalesce(F.when(F.col("n.status") != "", F.col("n.status")), F.lit("open")) == "open")
    severe = F.lower("n.message").rlike("|".join(SEVERE))
    return _issues(noted, 2, F.when(severe, "high").otherwise("medium"), "Red-Hat Finding", F.coalesce("n.message", F.lit("")), node=F.col("node_id"), place=F.col("position"), order=F.col("i"))


def _locked() -> Column:
    return F.col("pills") | F.col("text").rlike(LOCK_TOKEN)


def number_issues(nodes: DataFrame, ledger: DataFrame, parts: int) -> DataFrame:
    """Amounts that no lock verifies, the largest of a node named, and amounts above a baseline of the ledger."""
    stated = nodes.select("document_id", "node_id", "position", "cited", _locked().alias("locked"), dollar_claims(F.col("text")).alias("claims")).where("size(claims) > 0")
    largest = F.array_max(F.transform("claims", lambda c, i: F.struct(c["value"].alias("value"), (-i).alias("place"), c["words"].alias("words"))))["words"]
    missing = F.concat(F.lit("Numeric claim "), largest, F.lit(" in the Main document has no verified lock pill or substrate citation."))
    unbound = F.concat(F.lit("Numeric claim "), largest, F.lit(" is cited but not bound to a verified lock pill."))
    free = stated.where(~F.col("locked"))
    bare = _issues(free, 3, F.when(F.col("cited"), "medium").otherwise("high"), "Unverified Number", F.when(F.col("cited"), unbound).otherwise(missing), node=F.col("node_id"), place=F.col("position"), order=F.lit(-1))
    amounts = stated.select("document_id", "node_id", "position", F.posexplode("claims").alias("i", "c"))
    above = dealt(amounts, parts).join(dealt(ledger.select("document_id", "key", F.col("value").alias("baseline"), "place"), parts), "document_id").where("c.value > baseline")
    text = F.concat(F.lit("Aggregate liability limit exceeds "), label(F.col("key")), F.lit(" by $"), F.format_number(F.col("c.value") - F.col("baseline"), 0), F.lit("."))
    return bare.unionByName(_issues(above, 3, F.lit("high"), "Unverified Number", text, node=F.col("node_id"), place=F.col("position"), order=F.col("place") * (1 << 31) + F.col("i")))


def citation_issues(nodes: DataFrame) -> DataFrame:
    """Paragraphs with numbers that neither cite nor lock anything."""
    bare = nodes.where((F.col("type") == "paragraph") & F.col("text").rlike(r"\d") & ~_locked() & ~F.col("cited"))
    plain = F.trim("text")
    snippet = F.when(F.length(plain) > SNIPPET, F.concat(F.substring(plain, 1, SNIPPET - 3), F.lit("..."))).otherwise(plain)
    return _issues(bare, 4, F.lit("medium"), "Missing Citation", F.concat(F.lit('Paragraph contains verifiable numbers but no citation: "'), snippet, F.lit('"')), node=F.col("node_id"), place=F.col("position"))


def scan_documents(nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """document_id, id, severity, category, description and node_id of all issues.

    Issues are numbered as they are met and then anew by severity; numbers
    compare as text, as ids do. Ledger rows are document_id, key, value and
    place; rows without a number are left out. Null texts are empty.
    """
    known = ledger.where(F.col("value").isNotNull())
    plain = nodes.withColumn("text", F.coalesce("text", F.lit(""))).fillna(False, ["cited", "pills"])
    parts = nodes.count() // NODES_A_TASK + 1
    found = ledger_issues(plain, known, parts).unionByName(finding_issues(plain)).unionByName(number_issues(plain, known, parts)).unionByName(citation_issues(plain))
    once = dealt(found, parts).groupBy("document_id", "category", "description", "node_id").agg(F.min("at").alias("at"), F.min_by("severity", "at").alias("severity"))
    numbered = lambda n: F.concat(F.lit("issue-"), F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")))
    met = numbered(F.row_number().over(Window.partitionBy("document_id").orderBy("at", "description")))
    rank = F.array_position(F.array(*[F.lit(r) for r in _RANKS]), F.col("severity"))
    by_rank = once.withColumn("met", met).withColumn("rank", rank)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("rank", "met"))
    return by_rank.select("document_id", numbered(place).alias("id"), "severity", "category", "description", "node_id")


def order_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents: lines are nodes that state quantities, prices or parts; a ledger locks a quantity and a price limit."""
    kind = F.col("l_linenumber") % 3
    token = F.when(F.col("l_returnflag") == "R", " [🔒 #1]").otherwise("")
    body = (
        F.when(kind == 0, F.concat(F.lit("quantity = "), F.col("l_quantity").cast("int")))
        .when(kind == 1, F.concat(F.lit("Paid $"), F.floor("l_extendedprice"), F.when(F.col("l_partkey") % 5 == 0, "K").otherwise(""), F.lit(" of $5")))
        .otherwise(F.concat(F.lit("Part "), "l_partkey", F.lit(" shipped")))
    )

    def note(status: Column, message: str, when: Column) -> Column:
        none = F.array().cast("array<struct<status:string,message:string>>")
        return F.when(when, F.array(F.struct(status.alias("status"), F.lit(message).alias("message")))).otherwise(none)

    nodes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.concat_ws("-", F.lit("n"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("node_id"),
        (F.col("l_linenumber") * 10**15 + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("int")).alias("position"),
        F.when(F.col("l_linestatus") == "O", "paragraph").otherwise("callout").alias("type"),
        F.concat(body, token).alias("text"),
        F.array(F.lit("quantity")).alias("entities"),
        (F.col("l_partkey") % 4 == 0).alias("cited"),
        (F.col("l_partkey") % 9 == 0).alias("pills"),
        note(F.lit("violation"), "", F.col("l_discount") > 0.095).alias("z3"),
        note(F.when(F.col("l_returnflag") == "A", "resolved").otherwise("open"), "Unsupported tax", F.col("l_tax") > 0.075).alias("redhat"),
    )
    lock = lambda place, key, value: F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), value.alias("value"))
    locks = F.array(lock(0, "quantity", (F.col("o_orderkey") % 50).cast("double")), lock(1, "price_limit", F.floor(F.col("o_totalprice") / 10).cast("double")))
    ledger = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(locks).alias("l")).select("document_id", "l.*")
    return nodes, ledger


@query("""
WITH n AS (SELECT l_orderkey AS d, l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey * 100 + l_quantity::INT AS p, 'n-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS node, l_linenumber % 3 AS kind, l_quantity::INT AS q, floor(l_extendedprice)::BIGINT AS price, l_partkey % 5 = 0 AS thousands,
    l_partkey, l_linestatus = 'O' AS para, l_partkey % 4 = 0 AS cited, l_partkey % 9 = 0 OR l_returnflag = 'R' AS locked, l_returnflag, l_discount, l_tax,
    o_orderkey % 50 AS lock_q, floor(o_totalprice / 10)::BIGINT AS lock_p, CASE WHEN l_returnflag = 'R' THEN ' [🔒 #1]' ELSE '' END AS token FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
v AS (SELECT *, CASE kind WHEN 0 THEN 'quantity = ' || q WHEN 1 THEN 'Paid $' || price || CASE WHEN thousands THEN 'K' ELSE '' END || ' of $5' ELSE 'Part ' || l_partkey || ' shipped' END || token AS text, price * CASE WHEN thousands THEN 1000 ELSE 1 END AS amount FROM n),
wrong AS (SELECT *, 'Metric ''quantity''=' || q || '.0 contradicts locked == ' || lock_q || '.0' AS message FROM v WHERE kind = 0 AND q <> lock_q),
issues AS (
  SELECT d, 0 AS rule, -1 AS p, 0 AS o, 'high' AS severity, 'Z3 Contradiction' AS category, arg_min(message, p) AS description, NULL AS node FROM wrong GROUP BY d
  UNION ALL SELECT d, 1, p, -1, 'high', 'Z3 Contradiction', message, node FROM wrong
  UNION ALL SELECT d, 1, p, 0, 'high', 'Z3 Contradiction', 'Z3 constraint violation', node FROM v WHERE l_discount > 0.095
  UNION ALL SELECT d, 2, p, 0, 'high', 'Red-Hat Finding', 'Unsupported tax', node FROM v WHERE l_tax > 0.075 AND l_returnflag <> 'A'
  UNION ALL SELECT d, 3, p, -1, CASE WHEN cited THEN 'medium' ELSE 'high' END, 'Unverified Number', 'Numeric claim ' || CASE WHEN amount >= 5 THEN '$' || price || CASE WHEN thousands THEN 'K' ELSE '' END ELSE '$5' END
    || CASE WHEN cited THEN ' is cited but not bound to a verified lock pill.' ELSE ' in the Main document has no verified lock pill or substrate citation.' END, node FROM v WHERE kind = 1 AND NOT locked
  UNION ALL SELECT d, 3, p, b * 10 + i, 'high', 'Unverified Number', 'Aggregate liability limit exceeds ' || CASE b WHEN 0 THEN 'Quantity' ELSE 'Price Limit' END || ' by $' || format('{:,}', c - base) || '.', node
    FROM (SELECT v.*, unnest([0, 0, 1, 1]) AS b, unnest([0, 1, 0, 1]) AS i, unnest([amount, 5, amount, 5]) AS c, unnest([lock_q, lock_q, lock_p, lock_p]) AS base FROM v WHERE kind = 1) WHERE c > base
  UNION ALL SELECT d, 4, p, 0, 'medium', 'Missing Citation', 'Paragraph contains verifiable numbers but no citation: "' || text || '"', node FROM v WHERE para AND NOT locked AND NOT cited),
once AS (SELECT d, category, description, node, min((rule, p, o)) AS at_, arg_min(severity, (rule, p, o)) AS severity FROM issues GROUP BY ALL),
met AS (SELECT *, 'issue-' || lpad(row_number() OVER (PARTITION BY d ORDER BY at_, description)::VARCHAR, 2, '0') AS met FROM once)
SELECT d AS document_id, 'issue-' || lpad(row_number() OVER (PARTITION BY d ORDER BY severity <> 'high', met)::VARCHAR, 2, '0') AS id, severity, category, description, node AS node_id FROM met
""")
def v16_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of orders as documents."""
    return scan_documents(*order_documents(spark, sf_dir))
