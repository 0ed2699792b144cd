"""Job states: transitions, the guard against a second job, expiry, deletion; streams give what tables give."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from millrace.streaming import incremental, jobs

SCHEMA = "queue string, " + jobs.EVENT
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def log(spark, rows):
    return spark.createDataFrame([(q, at(s), n, a, j, st, f) for n, (q, s, a, j, st, f) in enumerate(rows)], SCHEMA)


def results(df):
    return [((r.at.replace(tzinfo=dt.UTC) if r.at.tzinfo is None else r.at) - T0, r.seq, r.job_id, r.result, r.state) for r in df.orderBy("at", F.col("seq").asc_nulls_first(), "job_id").collect()]


def test_transitions(spark):
    rows = [
        ("q", 0, "submit", "a", None, None), ("q", 10, "submit", "b", None, False), ("q", 20, "status", "a", "JOB_STATE_RUNNING", None), ("q", 30, "submit", "c", None, True),
        ("q", 40, "submit", "d", None, None), ("q", 50, "status", "a", "JOB_STATE_SUCCEEDED", None), ("q", 60, "status", "a", "JOB_STATE_RUNNING", None), ("q", 70, "status", "x", "JOB_STATE_RUNNING", None),
        ("q", 80, "delete", "c", None, None), ("q", 90, "submit", "e", None, None), ("q", 1000, "status", "e", "JOB_STATE_RUNNING", None), ("q", 1001, None, "e", None, None), (None, 1, "submit", "a", None, None),
    ]
    got = [(int(t.total_seconds()), j, r, s) for t, _, j, r, s in results(jobs.replay_jobs(log(spark, rows), 500))]
    assert got == [
        (0, "a", "submitted", "PENDING"), (10, "a", "active_job_exists", "PENDING"), (20, "a", "updated", "JOB_STATE_RUNNING"), (30, "c", "submitted", "PENDING"), (40, "c", "active_job_exists", "PENDING"),
        (50, "a", "updated", "COMPLETED"), (60, "a", "unchanged", "COMPLETED"), (70, "x", "not_found", None), (80, "c", "deleted", "PENDING"), (90, "e", "submitted", "PENDING"), (590, "e", "expired", "EXPIRED"),
        (1000, "e", "unchanged", "EXPIRED"),
    ]
    assert jobs.replay_jobs(log(spark, rows).where("false"), 500).collect() == []


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (f"q{rng.randrange(3)}", rng.randrange(4000), rng.choice(["submit", "submit", "status", "status", "delete"]), f"j{rng.randrange(6)}", rng.choice(["JOB_STATE_RUNNING", "JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED"]), rng.random() < 0.2)
        for _ in range(300)
    ]
    events = log(spark, rows)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    # Three arrivals whose times overlap within the lateness that is allowed, in three runs of the stream.
    for k in range(3):
        events.where((F.unix_timestamp("at") - int(T0.timestamp()) + F.col("seq") % 2 * 400 >= k * 1400) & (F.unix_timestamp("at") - int(T0.timestamp()) + F.col("seq") % 2 * 400 < (k + 1) * 1400 + (9999 if k == 2 else 0))).coalesce(1).write.mode("append").parquet(source)
        found = jobs.follow_jobs(incremental.follow(spark, source, events.schema), 600, "1000 seconds")
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()
    last = max(r[1] for r in rows) - 1000
    want = results(jobs.replay_jobs(events, 600, at(last)))
    assert results(spark.read.parquet(target)) == want
    assert {r for _, _, _, r, _ in want} == {"submitted", "active_job_exists", "updated", "unchanged", "deleted", "not_found", "expired"}


def test_an_event_does_not_look_at_every_job():
    # Twenty thousand active jobs, each heard of three times: minutes if every event looks at all of them.
    n = 20_000
    events = [(k, k, "submit" if k < n else "status", f"j{k % n}", "JOB_STATE_RUNNING", True) for k in range(4 * n)]
    known = {}
    began = time.process_time()
    out = list(jobs.advance(known, events, 10 * n, 20 * n))
    assert time.process_time() - began < 20
    assert [sum(r[3] == x for r in out) for x in ("submitted", "updated", "expired")] == [n, 3 * n, n]
    assert all(state == jobs.EXPIRED for state, _, _ in known.values()) and len(known) == n
