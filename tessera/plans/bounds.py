"""Metrics against conjunctions of bounds.

Every lock is a comparison of one variable with a constant, so what a key's
locks leave is an interval without some points. It is found by aggregation: the
largest lower bound, the smallest upper one, whether they belong to it, and the
points taken out. Locks that leave nothing contradict each other, and then no
value of any key of that ledger can be held, as with a solver that is given
all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table

#: The comparisons that a lock may state.
OPERATORS = ["==", "!=", "<=", ">=", "<", ">"]


def intervals(locks: DataFrame) -> DataFrame:
    """ledger, key, low, low_open, high, high_open and empty of the keys that ``locks`` (ledger, key, op, value) bound.

    Locks with an unknown comparison, without a value or with one that is no
    number are left out.
    """
    good = locks.where(F.col("op").isin(OPERATORS) & F.col("value").isNotNull() & ~F.isnan("value"))
    below = F.when(F.col("op").isin("==", ">=", ">"), F.struct("value", (F.col("op") == ">").alias("open")))
    above = F.when(F.col("op").isin("==", "<=", "<"), F.struct("value", (F.col("op") != "<").alias("closed")))
    # The largest lower bound, an open one after a closed one; the smallest upper bound, an open one before a closed one.
    bounds = good.groupBy("ledger", "key").agg(F.max(below).alias("low"), F.min(above).alias("high"))
    plain = bounds.select("ledger", "key", F.col("low.value").alias("low"), F.coalesce("low.open", F.lit(False)).alias("low_open"), F.col("high.value").alias("high"), F.coalesce(~F.col("high.closed"), F.lit(False)).alias("high_open"))
    points = good.where("op = '!='").select(F.col("ledger").alias("x_ledger"), F.col("key").alias("x_key"), F.col("value").alias("x_value")).distinct()
    same = F.col("ledger").eqNullSafe(F.col("x_ledger")) & F.col("key").eqNullSafe(F.col("x_key"))
    # One point is left at most where the bounds meet; only then can points taken out leave nothing.
    single = (F.col("low") == F.col("high")) & (F.col("x_value") == F.col("low"))
    met = plain.join(points, same & single, "left")
    empty = (F.col("low") > F.col("high")) | ((F.col("low") == F.col("high")) & (F.col("low_open") | F.col("high_open") | F.col("x_value").isNotNull()))
    return met.select("ledger", "key", "low", "low_open", "high", "high_open", F.coalesce(empty, F.lit(False)).alias("empty"))


def _within(value: Column) -> Column:
    over = F.col("low").isNull() | (value > F.col("low")) | ((value == F.col("low")) & ~F.col("low_open"))
    under = F.col("high").isNull() | (value < F.col("high")) | ((value == F.col("high")) & ~F.col("high_open"))
    return F.coalesce(over & under, F.lit(True))


def check_values(claims: DataFrame, locks: DataFrame) -> DataFrame:
    """``claims`` (claim_id, ledger, key, value) with contradicts, and the op and value of the key's last lock where it does.

    ``locks`` have a ``place``, the order in which they were stated. A value
    contradicts if the key's locks rule it out, or if any key's locks of the
    ledger leave nothing. Keys without locks hold any value; claims without a
    number are not checked (null).
    """
    bounds = intervals(locks)
    broken = bounds.where("empty").select(F.col("ledger").alias("b_ledger")).distinct().withColumn("broken", F.lit(True))
    points = locks.where((F.col("op") == "!=") & F.col("value").isNotNull()).select(F.col("ledger").alias("x_ledger"), F.col("key").alias("x_key"), F.col("value").alias("x_value")).distinct()
    last = locks.where(F.col("op").isin(OPERATORS) & F.col("value").isNotNull()).groupBy(F.col("ledger").alias("l_ledger"), F.col("key").alias("l_key")).agg(F.max_by(F.struct("op", "value"), "place").alias("last"))
    kept = bounds.select(F.col("ledger").alias("k_ledger"), F.col("key").alias("k_key"), "low", "low_open", "high", "high_open")

    def on(prefix: str) -> Column:
        return F.col("ledger").eqNullSafe(F.col(f"{prefix}_ledger")) & F.col("key").eqNullSafe(F.col(f"{prefix}_key"))

    met = claims.join(kept, on("k"), "left").join(points, on("x") & (F.col("value") == F.col("x_value")), "left")
    met = met.join(broken, F.col("ledger").eqNullSafe(F.col("b_ledger")), "left").join(last, on("l"), "left")
    out = ~_within(F.col("value")) | F.col("x_value").isNotNull() | F.col("broken").isNotNull()
    contradicts = F.when(F.col("value").isNotNull(), out)
    named = lambda field: F.when(contradicts, F.col(f"last.{field}"))
    return met.select(*claims.columns, contradicts.alias("contradicts"), named("op").alias("locked_op"), named("value").alias("locked_value"))


def first_violations(checked: DataFrame, place: str) -> DataFrame:
    """The first claim of each ledger that contradicts, in order of ``place``: what a check that stops there reports."""
    found = checked.where("contradicts")
    return found.groupBy("ledger").agg(F.min_by(F.struct(*[c for c in checked.columns if c != "ledger"]), place).alias("first")).select("ledger", "first.*")


_LOCKS = "locks AS (SELECT l_orderkey AS ledger, 'metric ' || l_linenumber % 3 AS key, (['==', '!=', '<=', '>=', '<', '>', '~'])[l_partkey % 7 + 1] AS op, (CASE WHEN l_partkey % 7 < 2 THEN l_linenumber ELSE floor(l_quantity / 10) END)::DOUBLE AS value, l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey * 100 + l_quantity::INT AS place FROM lineitem)"


def line_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as locks of their order's ledger, over three metrics."""
    op = F.element_at(F.array(*[F.lit(o) for o in [*OPERATORS, "~"]]), (F.col("l_partkey") % 7 + 1).cast("int"))
    value = F.when(F.col("l_partkey") % 7 < 2, F.col("l_linenumber").cast("double")).otherwise(F.floor(F.col("l_quantity") / 10).cast("double"))
    key = F.concat(F.lit("metric "), F.col("l_linenumber") % 3)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ledger"), key.alias("key"), op.alias("op"), value.alias("value"), (F.col("l_linenumber") * 10**15 + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("int")).alias("place"))


_CHECKED = f"""
{_LOCKS},
good AS (SELECT * FROM locks WHERE op <> '~'),
span AS (SELECT ledger, key, max(value) FILTER (op IN ('==', '>=', '>')) AS low, min(value) FILTER (op IN ('==', '<=', '<')) AS high FROM good GROUP BY 1, 2),
-- A key's locks leave something if a number between its neighbouring constants, or one of them, meets all of them.
tries AS (SELECT ledger, key, unnest([value, value - 0.5::DOUBLE, value + 0.5::DOUBLE]) AS x FROM good),
held AS (SELECT t.ledger, t.key, x, bool_and(CASE g.op WHEN '==' THEN x = g.value WHEN '!=' THEN x <> g.value WHEN '<=' THEN x <= g.value WHEN '>=' THEN x >= g.value WHEN '<' THEN x < g.value ELSE x > g.value END) AS ok
  FROM tries t JOIN good g ON g.ledger = t.ledger AND g.key = t.key GROUP BY 1, 2, 3),
empties AS (SELECT ledger, key FROM held GROUP BY 1, 2 HAVING NOT bool_or(ok)),
claims AS (SELECT o_orderkey * 4 + k AS claim_id, o_orderkey AS ledger, 'metric ' || k AS key, CASE WHEN o_custkey % 11 > 0 THEN (o_custkey % 6)::DOUBLE END AS value FROM orders, range(4) AS r(k)),
ruled AS (SELECT c.claim_id, bool_or(NOT CASE g.op WHEN '==' THEN c.value = g.value WHEN '!=' THEN c.value <> g.value WHEN '<=' THEN c.value <= g.value WHEN '>=' THEN c.value >= g.value WHEN '<' THEN c.value < g.value ELSE c.value > g.value END) AS bad
  FROM claims c JOIN good g ON g.ledger = c.ledger AND g.key = c.key GROUP BY 1),
verdicts AS (SELECT c.*, CASE WHEN c.value IS NOT NULL THEN coalesce(bad, false) OR c.ledger IN (SELECT ledger FROM empties) END AS contradicts FROM claims c LEFT JOIN ruled USING (claim_id)),
lasts AS (SELECT ledger, key, arg_max(op, place) AS op, arg_max(value, place) AS value FROM good GROUP BY 1, 2)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics of each order, one of which has no lock."""
    orders = table(spark, sf_dir, "orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    value = F.when(F.col("o_custkey") % 11 > 0, (F.col("o_custkey") % 6).cast("double"))
    return orders.select((F.col("o_orderkey") * 4 + F.col("k")).alias("claim_id"), F.col("o_orderkey").alias("ledger"), F.concat(F.lit("metric "), "k").alias("key"), value.alias("value"))


@query(f"""
WITH {_CHECKED}
SELECT v.claim_id, v.ledger, v.key, v.value, contradicts, CASE WHEN contradicts THEN l.op END AS locked_op, CASE WHEN contradicts THEN l.value END AS locked_value FROM verdicts v LEFT JOIN lasts l ON l.ledger = v.ledger AND l.key = v.key
""")
def v11_bound_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' metrics against all that their lines lock."""
    return check_values(_claims(spark, sf_dir), line_locks(spark, sf_dir))


@query(f"""
WITH {_CHECKED}
SELECT ledger, min(claim_id) AS claim_id, arg_min(key, claim_id) AS key, arg_min(value, claim_id) AS value FROM verdicts WHERE contradicts GROUP BY 1
""")
def v11_first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first metric of each order that contradicts its lines."""
    checked = check_values(_claims(spark, sf_dir), line_locks(spark, sf_dir))
    return first_violations(checked, "claim_id").select("ledger", "claim_id", "key", "value")
