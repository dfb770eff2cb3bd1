"""Streams with state: restarts, order within batches, expiry, redelivery; windows that edits open."""

import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.streaming import states
from tessera.streaming.debounce import openings, shared_windows
from tessera.streaming.jobs import first_seen

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
MOVES = "job_id string, stage string, move_id long, ts timestamp"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def run_batches(spark, tmp_path, batches, schema, make, mode):
    """Each batch as a file of its own and a run of its own, started again from the checkpoint."""
    out = []

    def keep(batch, number):
        out.append([r.asDict() for r in batch.collect()])

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
    return out


def plain_jobs(moves):
    jobs = {}
    for job_id, stage, _, ts in sorted(moves, key=lambda m: (m[3], m[2])):
        micros = int((ts - START).total_seconds() * 10**6) + int(START.timestamp()) * 10**6
        job = jobs.setdefault(job_id, {"status": None, "history": [], "refused": 0, "started": None, "finished": None})
        if stage not in states.STAGES or job["status"] in states.ENDS or (job["status"] is None and stage != "queued"):
            job["refused"] += 1
            continue
        if stage != "queued" and job["started"] is None:
            job["started"] = micros
        job["history"].append(f"{stage}@{micros}")
        job["status"] = stage
        if stage in states.ENDS:
            job["finished"] = micros
    return {k: (j["status"], ">".join(j["history"]), j["refused"], j["started"], j["finished"]) for k, j in jobs.items()}


def test_jobs_go_on_after_a_restart(spark, tmp_path):
    some = random.Random(4)
    moves = [(f"j{some.randint(0, 5)}", some.choice([*states.STAGES[:5], "queued", "done", "paused", None]), n, at(n)) for n in range(90)]
    moves += [("late", "done", 100, at(91)), ("late", "queued", 101, at(92)), ("late", "skipped", 102, at(93)), ("late", "queued", 103, at(94))]
    batches = [moves[:30], moves[30:31], moves[31:70], moves[70:]]
    shuffled = [some.sample(b, len(b)) for b in batches]
    out = run_batches(spark, tmp_path, shuffled, MOVES, states.job_states, "update")
    last = {r["job_id"]: r for batch in out for r in batch}
    assert {k: (r["status"], r["history"], r["refused"], r["started_us"], r["finished_us"]) for k, r in last.items()} == plain_jobs(moves)
    assert last["late"]["duration_ms"] == 60_000 and last["late"]["refused"] == 2


def test_jobs_are_forgotten(spark, tmp_path):
    moves = [[("a", "queued", 1, at(0))], [("b", "queued", 2, at(60 * 24 * 100))], [("b", "done", 3, at(60 * 24 * 100 + 1))], [("a", "done", 4, at(60 * 24 * 100 + 2))]]
    out = run_batches(spark, tmp_path, moves, MOVES, states.job_states, "update")
    last = {r["job_id"]: r for batch in out for r in batch}
    assert last["b"]["status"] == "done" and last["a"]["status"] is None and last["a"]["refused"] == 1


def test_jobs_share_groups(spark, tmp_path, monkeypatch):
    """Jobs of a shard move, and are forgotten, each by itself; there are no more groups than shards."""
    monkeypatch.setattr(states, "SHARDS", 3, raising=False)
    some = random.Random(8)
    moves = [(f"j{some.randint(0, 199)}", some.choice([*states.STAGES[:5], "queued", "done", "paused", None]), n, at(n)) for n in range(2000)]
    day = 60 * 24
    later = [(f"j{n}", "queued", 3000 + n, at(60 * day + n)) for n in range(0, 200, 2)]
    last = [("new", "queued", 4000, at(120 * day))]
    again = [(f"j{n}", "done", 5000 + n, at(120 * day + 1 + n)) for n in range(200)]
    out = run_batches(spark, tmp_path, [moves[:1200], moves[1200:], later, last, again], MOVES, states.job_states, "update")
    got = {r["job_id"]: (r["status"], r["history"], r["refused"], r["started_us"], r["finished_us"]) for batch in out for r in batch}
    # After 120 days only the jobs that moved on the sixtieth are known.
    gone = {f"j{n}" for n in range(1, 200, 2)}
    assert got == plain_jobs([m for m in moves if m[0] not in gone] + later + last + again)
    assert all(len({r["job_id"] for r in batch}) == len(batch) for batch in out)
    assert [len(batch) for batch in out if batch][2:] == [100, 1, 200]
    groups = spark.read.format("statestore").load(f"{tmp_path}/state").count()
    assert groups <= 3


def test_cache_entries_expire(spark, tmp_path):
    day = 60 * 24
    requests = [
        [(1, "k", "fetch", at(0)), (2, "k", "save", at(10)), (3, "k", "fetch", at(11))],
        [(4, "k", "fetch", at(10 + 30 * day - 1)), (5, "other", "fetch", at(20))],
        [(6, "k", "fetch", at(10 + 30 * day))],
        [(7, "k", "fetch", at(40 * day)), (8, "k", "save", at(40 * day + 1)), (9, "k", "fetch", at(40 * day + 2))],
    ]
    schema = "request_id long, key string, kind string, ts timestamp"
    out = [r for batch in run_batches(spark, tmp_path, requests, schema, states.cache_stream, "append") for r in batch]
    hits = {r["request_id"]: r["hit"] for r in out}
    assert hits == {1: False, 3: True, 4: True, 5: False, 6: False, 7: False, 9: True}
    frame = spark.createDataFrame([r for b in requests for r in b], schema).withColumn("at", F.unix_micros("ts"))
    plain = {r.request_id: r.hit for r in states.cache_lookups(frame).collect()}
    assert plain == hits


def test_a_batch_that_was_lost_is_written_once(spark, tmp_path):
    schema = "k long"
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).toDF("k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    deliveries = []

    def lost(number):
        deliveries.append(number)
        return deliveries.count(number) == 1 and number != 1

    got = states.delivered(stream, str(tmp_path), states.written_once(str(tmp_path), lost))
    assert sorted(r.k for r in got.collect()) == list(range(30))
    assert deliveries == [0, 0, 1, 2, 2]


def test_a_batch_that_always_fails_fails(spark, tmp_path):
    spark.range(3).toDF("k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="not committed"):
        states.delivered(stream, str(tmp_path), states.written_once(str(tmp_path), lambda number: True), tries=2)


def test_rows_are_first_seen_once(spark, tmp_path):
    """Rows repeat within and across batches, after any time, and one batch is delivered twice."""
    schema = "a string, b long"
    batches = [[("x", 1), ("x", 1), (None, 2)], [("x", 1), ("y", None)], [(None, 2), ("y", None), ("x", 2), ("x", 2)]]
    failed = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            write = first_seen(stream, str(tmp_path))

            def once_more(batch, number):
                write(batch, number)
                if number not in failed:
                    failed.append(number)
                    raise states.RedeliveredError("lost")

            run = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(once_more).start()
            try:
                run.awaitTermination()
            except StreamingQueryException as lost:
                assert "RedeliveredError: lost" in str(lost)
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out").select("a", "b").collect()
    assert sorted(map(str, got)) == sorted(f"Row(a={a!r}, b={b!r})" for a, b in {r for rows in batches for r in rows})
    assert failed == [0, 1, 2]


def plain_windows(points, hold):
    found = {}
    for key, t in sorted(points, key=lambda p: (str(p[0]), p[1])):
        own = found.setdefault(key, [])
        if not own or t >= own[-1][0] + hold:
            own.append([t, 0])
        own[-1][1] += 1
    return {(key, start, n) for key, own in found.items() for start, n in own}


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_that_edits_open(spark, seed):
    some = random.Random(seed)
    points = [(some.choice(["a", "b", None]), some.choice([some.randint(0, 300), some.randint(0, 9000)])) for _ in range(400)] + [("one", 5), ("one", 5), ("one", 15), ("one", 25)]
    rows = spark.createDataFrame([*points, ("a", None)], "who string, t long")
    got = shared_windows(rows, "who", F.col("t"), 10, 9).collect()
    assert {(r.who, r.start, r.edits) for r in got} == plain_windows(points, 10)
    assert all(r.fires_at == r.start + 9 for r in got)
    assert openings(rows.limit(0).select(F.col("who").alias("key"), "t"), 10).count() == 0
