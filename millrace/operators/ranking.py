"""Positions in a global order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written


#: First rows in order that one task takes; more are found by their positions.
ONE_TASK = 10_000


def with_position(df: DataFrame, *order: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of the columns (give a total order).

    Rows are range-partitioned (into ``parts``, or as the session has it) and sorted once; a partition's offset is the sum of the counts before it (a row a partition).
    WN-13.
    """
    cols = df.columns
    dealt = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(max(1, parts), *order)
    ordered = written(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.select(*cols, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def parse_limit(limit) -> tuple[int, int | None]:
    """FLT-01: (start, end) of a limit: nothing, 'all' and numbers up to 0 are everything, n the first n, 'a:b' a half-open slice."""
    text = "" if limit is None else str(limit).strip().lower()
    if text in ("", "all", "none"):
        return 0, None
    first, colon, last = text.partition(":")
    if not colon:
        n = int(first)
        return 0, n if n > 0 else None
    start = max(0, int(first)) if first.strip() else 0
    return start, int(last) if last.strip() and last.strip() not in ("all", "none") else None


def range_slice(df: DataFrame, limit, *order: str) -> DataFrame:
    """FLT-01, FLT-02, SL-03: the rows of a slice of all rows in order."""
    start, end = parse_limit(limit)
    if start == 0 and end is None:
        return df
    if start == 0 and end <= ONE_TASK:
        return df.orderBy(*order).limit(end)
    placed = with_position(df, *order)
    wanted = F.col("position") >= start
    return placed.where(wanted if end is None else wanted & (F.col("position") < end)).drop("position")


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """SL-02, SRC-15: page ``number`` (from 1) of ``size`` rows."""
    if number * size <= ONE_TASK:
        return df.orderBy(*order).offset((number - 1) * size).limit(size)
    return range_slice(df, f"{(number - 1) * size}:{number * size}", *order)


def range_shards(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """WN-14: ``df`` with the column shard: ranges of ceil(n / shards) rows in order."""
    placed = with_position(df, *order)
    total = placed.agg(F.count("*").alias("_total"))
    width = F.ceil(F.col("_total") / shards)
    return placed.join(F.broadcast(total), how="inner").withColumn("shard", F.floor(F.col("position") / width).cast("int")).drop("_total")


def latest(df: DataFrame, order: str) -> DataFrame:
    """WN-15: the row of the greatest ``order``."""
    return df.orderBy(F.desc(order)).limit(1)
