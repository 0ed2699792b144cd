"""Incremental work as Structured Streaming jobs: polling, resuming, keyed upserts and event-time sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.tables import last_wins


def follow(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """ST-05, ST-09: a stream of the Parquet files that appear in a folder. A table is its own folder or single file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        folder, pattern = where.getParent().toString(), where.getName()
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_pending(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """ST-01..04: ``work`` on each batch of new rows; all that is there now, or again ``every`` interval. The checkpoint resumes."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upsert_batches(target: str, key: list[str], order: list[str], merge_every: int = 16) -> Callable[[DataFrame, int], None]:
    """SNK-02 for streams: of each key the last row. A batch writes its own reduced rows only; every ``merge_every``-th batch
    writes the whole table, so that a reader merges few of them. A batch that is run again writes the same folder.
    """

    def work(batch: DataFrame, number: int) -> None:
        rows, whole = last_wins(batch, key, order), number % merge_every == 0
        if whole and number:
            rows = last_wins(current(batch.sparkSession, target, key, order, number).unionByName(rows), key, order)
        rows.write.mode("overwrite").parquet(f"{target}/{'whole' if whole else 'part'}={number}")

    return work


def _versions(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """(number, folder) of the batches under a target whose write has ended."""
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
    done = [f for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted((int(f.getName().split("=")[1]), f.toString()) for f in done)


def current(spark: SparkSession, target: str, key: list[str], order: list[str], before: int | None = None) -> DataFrame:
    """The table that :func:`upsert_batches` keeps: the newest whole version with the parts after it (before a batch's number)."""
    known = [(n, f) for n, f in _versions(spark, target) if before is None or n < before]
    first = max((n for n, f in known if f.rsplit("/", 1)[1].startswith("whole=")), default=0)
    return last_wins(spark.read.parquet(*[f for n, f in known if n >= first]), key, order)


def run_state(sums: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of sums over all that is there; each batch writes its changed rows with its number (column batch)."""

    def work(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number}")

    return sums.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums by event-time window and type; works on tables and on streams (where rows later than ``late`` are too late)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows per user; works on tables and on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", gap) if events.isStreaming else timed
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def job_states(events: DataFrame) -> DataFrame:
    """ST-06, WN-15: the latest state of each job from its log (job_id, at, state, processed, total)."""
    return last_wins(events, ["job_id"], ["at", "processed"])


def may_submit(jobs: DataFrame) -> bool:
    """ST-06: no second job while one is pending or running."""
    return jobs.where(F.col("state").isin("PENDING", "RUNNING")).isEmpty()
