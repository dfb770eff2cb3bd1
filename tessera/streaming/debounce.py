"""Edits gathered by the window that the first of them opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table
from tessera.storage import stored

MAX_ROUNDS = 64


def _next_openings(points: DataFrame, hold: int) -> DataFrame:
    """key, t and nt, the first point of the key at ``t + hold`` or later, of points (key, t).

    Time is cut into slots of ``hold``. The next opening lies in the slot after
    the point's own, behind ``t + hold``, or it is the first point of the next
    slot with points after that. So points are ordered within a key's slot
    only, and a key's slots among themselves.
    """
    slot = F.floor(F.col("t") / hold)
    there = points.select("key", "t", slot.alias("slot"), F.lit(None).cast("long").alias("asker"))
    asked = points.select("key", (F.col("t") + hold).alias("t"), (slot + 1).alias("slot"), F.col("t").alias("asker"))
    # From the slot's end: points come before askers of the same time, and the last point passed is the answer.
    passed = Window.partitionBy("key", "slot").orderBy(F.desc("t"), F.col("asker").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = there.unionByName(asked).withColumn("near", F.min(F.when(F.col("asker").isNull(), F.col("t"))).over(passed)).where("asker IS NOT NULL")

    heads = there.groupBy("key", "slot").agg(F.min("t").alias("head"))
    ahead = Window.partitionBy("key").orderBy("slot")
    after = [F.lead(F.struct("slot", "head"), n).over(ahead) for n in (1, 2)]
    far = heads.select("key", (F.col("slot") + 1).alias("slot"), F.when(after[0]["slot"] > F.col("slot") + 1, after[0]["head"]).otherwise(after[1]["head"]).alias("far"))
    return near.join(far, ["key", "slot"], "left").select("key", F.col("asker").alias("t"), F.coalesce("near", "far").alias("nt")).where("nt IS NOT NULL")


def openings(points: DataFrame, hold: int) -> DataFrame:
    """key and t of the points that open a window of ``hold``: a key's first one, and each first one after a window's end.

    Windows follow one another, so each is found from the one before it. Points
    hold the next opening if they were one; these pointers are doubled, and
    after as many rounds as the logarithm of the longest chain all openings are
    reached from the first. Joins are by key and time, so a key with very many
    points is spread like many keys.
    """
    jumps = stored(_next_openings(points, hold))
    reached = stored(points.groupBy("key").agg(F.min("t").alias("t")))
    known = reached.count()
    for _ in range(MAX_ROUNDS):
        further = reached.join(jumps, ["key", "t"]).select("key", F.col("nt").alias("t"))
        reached = stored(reached.unionByName(further).distinct())
        now = reached.count()
        if now == known:
            return reached
        known = now
        onward = jumps.select("key", F.col("t").alias("nt"), F.col("nt").alias("nnt"))
        jumps = stored(jumps.join(onward, ["key", "nt"]).select("key", "t", F.col("nnt").alias("nt")))
    raise RuntimeError(f"openings did not settle in {MAX_ROUNDS} rounds")


def shared_windows(edits: DataFrame, key: str, at: Column, hold: int, fires: int) -> DataFrame:
    """key, start, fires_at and edits of each window: the first edit opens it, those within ``hold`` fall in it, the next one opens another.

    Times are microseconds; a window's job fires ``fires`` after its start.
    Edits without a time are left out; edits of a null key are one key's.
    """
    points = stored(edits.select(F.col(key).alias("key"), at.alias("t")).where("t IS NOT NULL").groupBy("key", "t").agg(F.count("*").alias("n")))
    # Null keys meet nothing in joins by equality.
    named = points.select(F.struct("key").alias("key"), "t", "n")
    opened = openings(named.select("key", "t"), hold)
    # An edit's opening is in its own slot or in the one before it, which each hold one at most.
    slot = F.floor(F.col("start") / hold)
    reach = opened.select("key", F.col("t").alias("start")).select("key", "start", F.explode(F.array(slot, slot + 1)).alias("slot"))
    met = named.withColumn("slot", F.floor(F.col("t") / hold)).join(reach, ["key", "slot"]).where("start <= t")
    own = met.groupBy("key", "t", "n").agg(F.max("start").alias("start"))
    return own.groupBy("key", "start").agg(F.sum("n").alias("edits")).select(F.col("key.key").alias(key), "start", (F.col("start") + fires).alias("fires_at"), "edits")


_HOURS = 3600 * 10**6


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events),
n AS (SELECT a.user_id, a.t, min(b.t) AS nt FROM p a JOIN p b ON a.user_id = b.user_id AND b.t >= a.t + 21601000000 GROUP BY 1, 2),
o AS (SELECT user_id, min(t) AS t FROM p GROUP BY 1 UNION ALL SELECT n.user_id, n.nt FROM o JOIN n ON o.user_id = n.user_id AND o.t = n.t),
e AS (SELECT user_id, epoch_us(ts) AS t FROM events)
SELECT e.user_id, o.t AS start, o.t + 21600000000 AS fires_at, count(*) AS edits FROM e ASOF JOIN o ON e.user_id = o.user_id AND e.t >= o.t GROUP BY 1, 2, 3
""")
def r2_shared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of each project by shared windows of six hours, held a second longer than the job waits."""
    return shared_windows(table(spark, sf_dir, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), 6 * _HOURS + 10**6, 6 * _HOURS)
