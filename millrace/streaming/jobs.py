"""ST-06: asynchronous jobs as a state machine over a log of events, the same for streams and tables.

A queue takes one active job at a time. Events of a queue, in the order of (at, seq):

* submit: a new job is PENDING; while another one of the queue is active it is refused, unless forced;
* status: an active job takes the state that its service reports; SUCCEEDED becomes COMPLETED; ended jobs don't change;
* delete: the job is forgotten, in whatever state.

A job that is active and isn't heard of for ``ttl`` seconds EXPIRES at that moment, whether or not another event comes.

:func:`follow_jobs` runs this with state in the state store: events wait in list state until the watermark has passed them, so
their order doesn't depend on how they arrive; a timer for the next waiting event or expiry wakes a queue that gets no rows.
:func:`replay_jobs` gives the same rows from a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The states in which a job is active, and the report that ends it well.
ACTIVE = ("PENDING", "JOB_STATE_PENDING", "JOB_STATE_RUNNING", "LOCAL_QUEUED")
SUCCEEDED, COMPLETED, EXPIRED = "JOB_STATE_SUCCEEDED", "COMPLETED", "EXPIRED"
EVENT = "at timestamp, seq long, action string, job_id string, state string, force boolean"
RESULT = "queue string, at timestamp, seq long, job_id string, result string, state string"

#: A queue's jobs: job_id -> (state, when last heard of in seconds, number of its submission).
Jobs = dict[str, tuple[str, int, int]]


def _deadlines(jobs: Jobs, ttl: int) -> list[tuple[int, int, str]]:
    return [(heard + ttl, no, job) for job, (state, heard, no) in jobs.items() if state in ACTIVE]


class _Queue:
    """Jobs with heaps of deadlines, active ones and numbers: an event costs the logarithm of the jobs, not a look at each.

    Entries that a later event has outdated stay in the heaps until they come up.
    """

    def __init__(self, jobs: Jobs, ttl: int):
        self.jobs, self.ttl = jobs, ttl
        self.due = _deadlines(jobs, ttl)
        self.active = [(-no, job) for _, no, job in self.due]
        self.numbers = [(-no, job) for job, (_, _, no) in jobs.items()]
        for heap in (self.due, self.active, self.numbers):
            heapq.heapify(heap)

    def set(self, job: str, state: str, heard: int, no: int) -> None:
        old = self.jobs.get(job)
        self.jobs[job] = (state, heard, no)
        if state in ACTIVE:
            heapq.heappush(self.due, (heard + self.ttl, no, job))
        if old is None or old[2] != no:
            heapq.heappush(self.numbers, (-no, job))
            if state in ACTIVE:
                heapq.heappush(self.active, (-no, job))

    def _first(self, heap: list[tuple[int, str]], states: tuple | None) -> str | None:
        while heap:
            no, job = heap[0]
            now = self.jobs.get(job)
            if now is not None and now[2] == -no and (states is None or now[0] in states):
                return job
            heapq.heappop(heap)
        return None

    def newest_active(self) -> str | None:
        return self._first(self.active, ACTIVE)

    def next_number(self) -> int:
        job = self._first(self.numbers, None)
        return 1 if job is None else self.jobs[job][2] + 1

    def expire(self, upto: int) -> Iterator[tuple]:
        while self.due and self.due[0][0] <= upto:
            due, no, job = heapq.heappop(self.due)
            now = self.jobs.get(job)
            if now is not None and now[0] in ACTIVE and now[1:] == (due - self.ttl, no):
                self.jobs[job] = (EXPIRED, due, no)
                yield due, None, job, "expired", EXPIRED


def advance(jobs: Jobs, events: list[tuple], ttl: int, upto: int) -> Iterator[tuple]:
    """(at, seq, job_id, result, state) of what happens to ``jobs`` by events (at, seq, action, job_id, state, force) in order, and until ``upto``."""
    queue = _Queue(jobs, ttl)
    for at, seq, action, job, reported, force in events:
        yield from queue.expire(at)
        old = jobs.get(job)
        if action == "submit":
            name = queue.newest_active()
            if name is not None and not force:
                yield at, seq, name, "active_job_exists", jobs[name][0]
            else:
                queue.set(job, "PENDING", at, queue.next_number())
                yield at, seq, job, "submitted", "PENDING"
        elif old is None:
            yield at, seq, job, "not_found", None
        elif action == "delete":
            del jobs[job]
            yield at, seq, job, "deleted", old[0]
        elif old[0] in ACTIVE and reported is not None:
            state = COMPLETED if reported == SUCCEEDED else reported
            queue.set(job, state, at, old[2])
            yield at, seq, job, "updated", state
        else:
            yield at, seq, job, "unchanged", old[0]
    yield from queue.expire(upto)


def _seconds(t) -> int:
    return int(pd.Timestamp(t).timestamp())


def _events(part: pd.DataFrame) -> list[tuple]:
    """Events of a part as plain values, whole columns at a time."""
    at = (part["at"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist()
    state = part["state"].astype(object).where(part["state"].notna(), None).tolist()
    return list(zip(at, part["seq"].astype("int64").tolist(), part["action"].tolist(), part["job_id"].tolist(), state, part["force"].astype(bool).tolist(), strict=True))


def _frame(queue: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(queue, pd.Timestamp(at, unit="s"), seq, job, result, state) for at, seq, job, result, state in rows], columns=["queue", "at", "seq", "job_id", "result", "state"])
    return out.astype({"seq": "Int64"})


class JobMachine(StatefulProcessor):
    """The state of one queue: its jobs, and events that wait for the watermark."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", "state string, heard long, no long")
        self.waiting = handle.getListState("waiting", "at long, seq long, action string, job_id string, state string, force boolean")
        self.timer = handle.getValueState("timer", "due long")

    def _moved(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Does all that is due at the watermark, and sets the timer for what comes next."""
        upto = watermark_ms // 1000
        waiting = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2])
        due, later = [e for e in waiting if e[0] <= upto], [e for e in waiting if e[0] > upto]
        jobs: Jobs = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        before = dict(jobs)
        rows = list(advance(jobs, due, self.ttl, upto))
        for job in before.keys() - jobs.keys():
            self.jobs.removeKey((job,))
        for job, value in jobs.items():
            if before.get(job) != value:
                self.jobs.updateValue((job,), value)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        coming = [e[0] for e in later[:1]] + [d for d, *_ in _deadlines(jobs, self.ttl)]
        set_for = self.timer.get() if self.timer.exists() else None
        if set_for is not None and set_for[0] * 1000 > watermark_ms:
            self.handle.deleteTimer(set_for[0] * 1000)
        if coming:
            self.handle.registerTimer(min(coming) * 1000)
            self.timer.update((min(coming),))
        else:
            self.timer.clear()
        if rows:
            yield _frame(key[0], rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark_ms, firsts = max(0, timerValues.getCurrentWatermarkInMs()), []
        for part in rows:
            new = _events(part)
            self.waiting.appendList(new)
            firsts += [min(e[0] for e in new)] if new else []
        first = min(firsts, default=None)
        if first is not None and first > watermark_ms // 1000:
            # Nothing of it is due: what waits isn't read, only the timer may come earlier. A timer that is due fires by itself.
            set_for = self.timer.get()[0] if self.timer.exists() else None
            if set_for is None or first < set_for:
                if set_for is not None:
                    self.handle.deleteTimer(set_for * 1000)
                self.handle.registerTimer(first * 1000)
                self.timer.update((first,))
        else:
            yield from self._moved(key, watermark_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._moved(key, max(0, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def _log(events: DataFrame) -> DataFrame:
    """Whole events: a queue, a time, a number, an action and a job."""
    cast = events.select(F.col("queue").cast("string").alias("queue"), *[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in EVENT.split(", "))])
    whole = F.col("queue").isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull() & F.col("action").isin("submit", "status", "delete") & F.col("job_id").isNotNull()
    return cast.where(whole).withColumn("force", F.coalesce("force", F.lit(False))).withColumn("at", F.date_trunc("second", "at"))


def follow_jobs(events: DataFrame, ttl: int, late: str = "0 seconds") -> DataFrame:
    """The rows of RESULT of a stream of ``events`` (queue and EVENT); events later than ``late`` are dropped."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = _log(events).withWatermark("at", late)
    return marked.groupBy("queue").transformWithStateInPandas(JobMachine(ttl), RESULT, "append", "EventTime")


def replay_jobs(events: DataFrame, ttl: int, upto=None) -> DataFrame:
    """The rows that :func:`follow_jobs` gives for a whole table of events, up to a moment (or the last event's).

    A queue's events are one sorted group: its jobs depend on each other. They are short rows, and a log has many queues.
    """
    log = _log(events)
    end = log.agg(F.max("at").alias("_end")) if upto is None else log.sparkSession.range(1).select(F.lit(upto).cast("timestamp").alias("_end"))

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        last = _seconds(part["_end"].iloc[0])
        rows = _events(part)
        return _frame(key[0], list(advance({}, sorted((r for r in rows if r[0] <= last), key=lambda e: e[:2]), ttl, last)))

    # One row, the end of the log, beside each event.
    return log.join(F.broadcast(end), how="inner").groupBy("queue").applyInPandas(fold, RESULT)
