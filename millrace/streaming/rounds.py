"""ST-04, ST-09: a table worked off in rounds, driven by a streaming source with offsets of its own.

The source's offset is the next index to be done, and its rows are rounds (start, stop), not data. A round admits at most
``limit`` ranks; after it the source rests for ``cooldown`` seconds, admits nothing at or after the hour ``window_end``, and
nothing after ``max_rounds`` rounds of one start. The checkpoint holds the offset: a job that is stopped, or whose round fails,
begins again with the round that wasn't committed.

Spark reads a round's rows from the table that :func:`numbered` wrote, only the folders of ranks that the round meets.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.ranking import with_position

RANKS_A_PART = 1_000_000


def numbered(rows: DataFrame, order: list[str], folder: str, ranks_a_part: int = RANKS_A_PART) -> int:
    """Writes the rows with their rank (from 0) in a total ``order`` to ``folder``, a folder for each ``ranks_a_part`` ranks
    (column rank_part); returns how many there are. An existing column ``rank`` or ``rank_part`` is an error.
    """
    if {"rank", "rank_part"} & set(rows.columns):
        raise ValueError("the rows have a column rank or rank_part")
    placed = with_position(rows, *order, name="rank").withColumn("rank_part", F.floor(F.col("rank") / ranks_a_part).cast("long"))
    placed.write.mode("overwrite").partitionBy("rank_part").parquet(folder)
    return rows.sparkSession.read.schema("rank long").parquet(folder).count()


def of_round(spark: SparkSession, schema: StructType, folder: str, start: int, stop: int, ranks_a_part: int = RANKS_A_PART) -> DataFrame:
    """The rows of the numbered table with start <= rank < stop."""
    table = spark.read.schema(schema.add("rank", "long").add("rank_part", "long")).parquet(folder)
    parts = F.col("rank_part").between(start // ranks_a_part, (stop - 1) // ranks_a_part)
    return table.where(parts & (F.col("rank") >= start) & (F.col("rank") < stop)).drop("rank_part")


class _Rounds(SimpleDataSourceStreamReader):
    """Lives as long as a start of the stream: its rounds and its rest are those of this start."""

    def __init__(self, options: dict):
        self.total, self.limit, self.cooldown = int(options["total"]), int(options["limit"]), float(options["cooldown"])
        self.window_end, self.max_rounds = int(options["window_end"]), int(options["max_rounds"])
        self.rounds, self.rests_until = 0, 0.0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next round, if one may run now; else no row and the same offset."""
        first = start["next"]
        if first >= self.total or not self._admits():
            return iter([]), start
        self.rounds, self.rests_until = self.rounds + 1, time.time() + self.cooldown
        end = {"next": min(first + self.limit, self.total)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["next"], end["next"])])

    def _admits(self) -> bool:
        if self.max_rounds and self.rounds >= self.max_rounds:
            return False
        return time.time() >= self.rests_until and not (self.window_end and time.localtime().tm_hour >= self.window_end)


class RoundSource(DataSource):
    """Format ``rounds`` with the options of :func:`run_rounds`."""

    @classmethod
    def name(cls) -> str:
        return "rounds"

    def schema(self) -> str:
        return "start long, stop long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Rounds(self.options)


def run_rounds(
    spark: SparkSession, folder: str, schema: StructType, total: int, work: Callable[[DataFrame, int, int], None], checkpoint: str,
    limit: int = 50, cooldown: float = 0, window_end: int = 0, max_rounds: int = 0, ranks_a_part: int = RANKS_A_PART,
) -> StreamingQuery:
    """``work(rows, start, stop)`` on each round of the numbered table in ``folder`` (``schema``: without ranks).

    A round that fails ends the query and is run again with the same start and stop by the next one on this checkpoint, so work
    that writes a folder named by ``start`` leaves every row once. Limits of 0 don't hold; ``limit`` is at least 1.
    """
    if limit < 1:
        raise ValueError("a round has at least one row")
    spark.dataSource.register(RoundSource)
    options = {"total": total, "limit": limit, "cooldown": cooldown, "window_end": window_end, "max_rounds": max_rounds}

    def each(batch: DataFrame, number: int) -> None:
        for r in batch.collect():  # a row a round
            work(of_round(batch.sparkSession, StructType(list(schema.fields)), folder, r["start"], r["stop"], ranks_a_part), r["start"], r["stop"])

    stream = spark.readStream.format("rounds").options(**options).load()
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
