"""Streams with state of their own: jobs that move from stage to stage, a cache whose entries expire, batches delivered twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.registry import query
from tessera.sources.tables import table
from tessera.streaming.jobs import drained, event_stream, shared_folder

#: The stages of a job, and those that end it.
STAGES = ["queued", "fetching", "parsing", "verifying", "persisting", "done", "failed", "skipped"]
ENDS = ["done", "failed", "skipped"]

#: State is dropped so long after a job's last move, in milliseconds.
FORGOTTEN_MS = 90 * 24 * 3600 * 1000

#: So many groups share a stream's jobs. What Spark does in Python for each group costs as much as hundreds of moves.
SHARDS = 4096

_JOB = "status string, history string, refused long, created_us long, started_us long, finished_us long, duration_ms long"
_FIELDS = [field.split()[0] for field in _JOB.split(", ")]
_SHARD = f"jobs array<struct<job_id string, {_JOB}, due_ms long>>"


def _move(job: list, stage: str | None, at: int) -> None:
    """One move of a job, in place: status, history, refused, created, started, finished, duration."""
    status = job[0]
    if stage not in STAGES or status in ENDS or (status is None and stage != "queued"):
        job[2] += 1
        return
    if status is None:
        job[3] = at
    if stage in ENDS:
        job[5] = at
        job[6] = (at - (job[3] if job[4] is None else job[4])) // 1000
    if stage != "queued" and job[4] is None:
        job[4] = at
    job[0] = stage
    job[1] = f"{job[1]}>{stage}@{at}" if job[1] else f"{stage}@{at}"


def _joined(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([b for b in batches if len(b)])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A shard's jobs after a batch; each has its own time to be dropped, and the shard's timeout is the first of them."""
    now = state.getCurrentWatermarkMs()
    jobs = {job_id: list(job) for job_id, *job in state.get[0]} if state.exists else {}
    touched = {}
    if not state.hasTimedOut:
        moves = _joined(batches).sort_values(["at", "move_id"])
        for job_id, stage, at in zip(moves["job_id"], moves["stage"], map(int, moves["at"]), strict=True):
            if job_id not in touched:
                touched[job_id] = jobs.setdefault(job_id, [None, "", 0, None, None, None, None, 0])
            job = touched[job_id]
            _move(job, stage, at)
            job[-1] = max(at // 1000 + FORGOTTEN_MS, now + 1)
    live = [(job_id, *job) for job_id, job in jobs.items() if job_id in touched or job[-1] >= now]
    if live:
        state.update((live,))
        state.setTimeoutTimestamp(max(min(job[-1] for job in live), now + 1))
    else:
        state.remove()
    if touched:
        rows = pd.DataFrame([(job_id, *job[:-1]) for job_id, job in touched.items()], columns=["job_id", *_FIELDS], dtype=object)
        yield rows.astype({n: "Int64" for n in _FIELDS if n.endswith(("_us", "_ms")) or n == "refused"})


def job_states(moves: DataFrame, shards: int | None = None) -> DataFrame:
    """Jobs as they stand after each batch of a stream of moves (job_id, stage, move_id, ts).

    A job is created by ``queued`` and goes through any of ``STAGES`` until one
    of ``ENDS``. Moves of a job that is not there or has ended, and unknown or
    null stages, are refused and counted. The history, ``stage@microseconds``
    joined by ``>``, is kept in the state and grows in the same step as the
    status; so do the start (the first stage after ``queued``), the end, and the
    milliseconds from a start before it, or else from the creation. Of a batch a job's moves count in order of time
    and id. A job's state is dropped 90 days after its last move.

    Every job that a batch touches is put out whole, so the last row of each
    job is how it stands.

    The state is kept by shards, ``SHARDS`` of them by default, so the number
    of groups doesn't grow with that of jobs. A batch writes the shards that it
    touches anew; more of them hold fewer jobs each. A stream must go on with as
    many as it began with.
    """
    shard = F.pmod(F.xxhash64("job_id"), F.lit(shards or SHARDS)).alias("shard")
    seen = moves.withWatermark("ts", "1 hour").select(shard, "job_id", "stage", "move_id", F.unix_micros("ts").alias("at"), "ts")
    return seen.groupBy("shard").applyInPandasWithState(_advance, f"job_id string, {_JOB}", _SHARD, "update", GroupStateTimeout.EventTimeTimeout)


def _week_job(ts: Column) -> Column:
    return F.concat_ws("-", F.col("user_id"), F.floor(F.unix_micros(ts) / F.lit(7 * 24 * 3600 * 10**6)))


def job_moves(events: DataFrame) -> DataFrame:
    """Events as moves of jobs, one for each project and week: two of ten kinds are no stage of a job, half are of its beginning."""
    named = F.array(*[F.lit(s) for s in [*STAGES[:5], "queued", "done", "failed", "paused"]], F.lit(None).cast("string"))
    return events.select(_week_job(F.col("ts")).alias("job_id"), F.element_at(named, (F.col("event_id") % 10 + 1).cast("int")).alias("stage"), F.col("event_id").alias("move_id"), "ts")


@query("""
WITH m AS (SELECT user_id || '-' || (epoch_us(ts) // 604800000000) AS job_id, event_id, epoch_us(ts) AS t,
    (['queued', 'fetching', 'parsing', 'verifying', 'persisting', 'queued', 'done', 'failed', 'paused', NULL])[event_id % 10 + 1] AS stage FROM events),
known AS (SELECT * FROM m WHERE stage IS NOT NULL AND stage <> 'paused'),
born AS (SELECT job_id, min((t, event_id)) AS born FROM known WHERE stage = 'queued' GROUP BY 1),
alive AS (SELECT k.* FROM known k JOIN born b ON b.job_id = k.job_id AND (k.t, k.event_id) >= b.born),
ended AS (SELECT job_id, min((t, event_id)) AS ended FROM alive WHERE stage IN ('done', 'failed') GROUP BY 1),
kept AS (SELECT a.* FROM alive a LEFT JOIN ended e USING (job_id) WHERE e.ended IS NULL OR (a.t, a.event_id) <= e.ended),
jobs AS (
  SELECT job_id, arg_max(stage, (t, event_id)) AS status, string_agg(stage || '@' || t, '>' ORDER BY t, event_id) AS history, count(*) AS moves, min(t) AS created_us,
    min(t) FILTER (stage <> 'queued') AS started_us, min(t) FILTER (stage NOT IN ('queued', 'done', 'failed')) AS before_us, min(t) FILTER (stage IN ('done', 'failed')) AS finished_us FROM kept GROUP BY 1)
SELECT job_id, status, coalesce(history, '') AS history, n - coalesce(moves, 0) AS refused, created_us, started_us, finished_us,
  CASE WHEN finished_us IS NOT NULL THEN (finished_us - coalesce(before_us, created_us)) // 1000 END AS duration_ms
FROM (SELECT job_id, count(*) AS n FROM m GROUP BY 1) LEFT JOIN jobs USING (job_id)
""")
def r4_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after all moves of the stream."""
    states = drained(job_states(job_moves(event_stream(spark, sf_dir))), "update")
    last = states.groupBy("job_id").agg(F.max_by(F.struct(*_FIELDS), "batch").alias("s"))
    return last.select("job_id", "s.*")


#: How long an entry of the cache counts.
CACHE_DAYS = 30
_DAY_US = 24 * 3600 * 10**6


def cache_lookups(requests: DataFrame, days: int = CACHE_DAYS) -> DataFrame:
    """request_id, key, hit and age_us of each look-up among ``requests`` (request_id, key, at, kind), ``at`` in microseconds.

    A ``save`` writes the key's entry anew, and a ``fetch`` finds it for
    ``days``; what has expired is missed, as is a key never saved. Of one time,
    requests count in order of id. Only a key's last save is carried, so a
    running maximum serves, whatever the number of saves.
    """
    before = Window.partitionBy("key").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = requests.withColumn("saved", F.max(F.when(F.col("kind") == "save", F.col("at"))).over(before))
    age = F.col("at") - F.col("saved")
    hit = F.coalesce(age < days * _DAY_US, F.lit(False))
    return saved.where("kind = 'fetch'").select("request_id", "key", hit.alias("hit"), F.when(hit, age).alias("age_us"))


def _look_up(life_us: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _joined(batches).sort_values(["at", "request_id"])
        saves = rows["at"].where(rows["kind"] == "save")
        before = state.get[0] if state.exists else None
        saved = saves.ffill() if before is None else saves.ffill().fillna(before)
        newest = saves.max() if before is None else max(before, saves.max()) if saves.notna().any() else before
        if pd.notna(newest):
            state.update((int(newest),))
            due = (int(newest) + life_us) // 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:
                state.remove()
        found = rows.assign(age_us=(rows["at"] - saved).astype("Int64"), key=key[0])
        found["hit"] = (found["age_us"] < life_us).fillna(False).astype(bool)
        found["age_us"] = found["age_us"].where(found["hit"])
        yield found.loc[found["kind"] == "fetch", ["request_id", "key", "hit", "age_us"]]

    return run


def cache_stream(requests: DataFrame, days: int = CACHE_DAYS) -> DataFrame:
    """:func:`cache_lookups` of a stream, with the time of each request in ``ts``.

    The state of a key is the time of its last save, and goes when the entry
    has expired by the watermark.
    """
    seen = requests.withWatermark("ts", "1 hour").select("request_id", "key", "kind", F.unix_micros("ts").alias("at"), "ts")
    out = "request_id long, key string, hit boolean, age_us long"
    return seen.groupBy("key").applyInPandasWithState(_look_up(days * _DAY_US), out, "saved long", "append", GroupStateTimeout.EventTimeTimeout)


_LOOKUPS = """
WITH r AS ({requests}),
s AS (SELECT *, max(CASE WHEN kind = 'save' THEN t END) OVER (PARTITION BY key ORDER BY t, request_id ROWS UNBOUNDED PRECEDING) AS saved FROM r)
SELECT request_id, key, coalesce(t - saved < {days} * 86400000000, false) AS hit, CASE WHEN t - saved < {days} * 86400000000 THEN t - saved END AS age_us FROM s WHERE kind = 'fetch'
"""


@query(_LOOKUPS.format(days=3, requests="SELECT event_id AS request_id, user_id::VARCHAR AS key, epoch_us(ts) AS t, CASE WHEN event_type = 'purchase' THEN 'save' ELSE 'fetch' END AS kind FROM events"))
def r6_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups of a project's cached result as they stream in; entries live three days of the month that the events span."""
    kind = F.when(F.col("event_type") == "purchase", "save").otherwise("fetch")
    requests = event_stream(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("key"), kind.alias("kind"), "ts")
    return drained(cache_stream(requests, 3)).select("request_id", "key", "hit", "age_us")


@query(_LOOKUPS.format(days=30, requests="SELECT o_orderkey AS request_id, o_custkey::VARCHAR AS key, epoch_us(o_orderdate) AS t, CASE WHEN o_orderpriority < '3' THEN 'save' ELSE 'fetch' END AS kind FROM orders"))
def r6_cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups of customers' cached results over years, with entries that live thirty days."""
    orders = table(spark, sf_dir, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    kind = F.when(F.col("o_orderpriority") < "3", "save").otherwise("fetch")
    return cache_lookups(orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").cast("string").alias("key"), at.alias("at"), kind.alias("kind")))


class RedeliveredError(RuntimeError):
    """A batch that was written but not committed."""


def written_once(folder: str, lost: Callable[[int], bool] = lambda number: False) -> Callable[[DataFrame, int], None]:
    """A writer of batches that leaves one copy of each, however often it is delivered.

    A batch goes to the part of the table that its number names and replaces
    what an earlier delivery left there. ``lost`` says of a number whether the
    delivery is lost after its write, before the stream could commit it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/n={number}")
        if lost(number):
            raise RedeliveredError(f"batch {number} was written but not committed")

    return write


def delivered(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], tries: int = 3) -> DataFrame:
    """Runs ``stream`` into ``folder`` until it is read to its end, again from the last commit where a batch failed; gives the table."""
    for last in range(tries - 1, -1, -1):
        run = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        try:
            run.awaitTermination()
            break
        except StreamingQueryException as failed:
            if not last or RedeliveredError.__name__ not in str(failed):
                raise
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").select(stream.columns)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE value > 10")
def r8_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken from a stream whose every batch is written, lost before its commit, and delivered again."""
    folder = shared_folder(spark)
    seen: set[int] = set()

    def lost(number: int) -> bool:
        first = number not in seen
        seen.add(number)
        return first

    rows = event_stream(spark, sf_dir).where("value > 10").select("event_id", "user_id", "event_type", "value")
    return delivered(rows, folder, written_once(folder, lost))
