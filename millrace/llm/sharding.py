"""Sharding by sampled splitters, with DataFrame functions only.

Records are put in the order of (hash of the text, doc_id, a number of the row). The row's number only parts records that are
equal in all else, so that many of them needn't be one range; which of them comes first changes nothing. A size-weighted sample of these keys gives
splitters at its quantiles; ranges that turn out overfull get further splitters from a denser sample.
Exact range sizes then place every record: shard i holds the records that start in the i-th equal part of
all bytes, so shards differ by about one record or one small group of equal texts.

Defined results: a null text counts as empty (size 16, CRC 0); a null doc_id sorts before all others; repeated
rows are separate records; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: A record's overhead in bytes beside its text.
RECORD_BYTES = 16
#: Leading bits of the key by which splitters are looked up.
SLICE_BITS = 8
#: Most ranges, and so most splitters that are ever collected or broadcast (32 bytes each).
MAX_RANGES = 65_536
_FIRST = -(2**63)


def _record_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k"),
        F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("d"),
        F.monotonically_increasing_id().alias("s"),
    )


Cut = tuple[int, int, int]


def _draw(keyed: DataFrame, per_byte: float, seed: int) -> list[Cut]:
    """Keys drawn with a chance in proportion to their record's size; their expected number is bounded by the caller."""
    u = F.pmod(F.xxhash64("k", "d", "s", F.lit(seed)), F.lit(2**40)) / float(2**40)
    return [(r.k, r.d, r.s) for r in keyed.where(u < F.col("size") * F.lit(per_byte)).select("k", "d", "s").collect()]


def _order(cut: Cut) -> tuple[int, int, int, int]:
    return (cut[0] >> (64 - SLICE_BITS)) & ((1 << SLICE_BITS) - 1), *cut


def _cuts(sample: list[Cut], n: int) -> list[Cut]:
    """Quantiles of a sample. A key that fills one quantile at most isn't divided: equal texts, and equal rows, stay together."""
    ordered = sorted(sample, key=_order)
    picked = [ordered[len(ordered) * i // n] for i in range(1, n)] if len(ordered) >= n > 1 else ordered
    texts, rows = Counter(k for k, _, _ in picked), Counter((k, d) for k, d, _ in picked)
    return sorted({(k, d if texts[k] > 1 else _FIRST, s if rows[k, d] > 1 else _FIRST) for k, d, s in picked}, key=_order)


def _range_of(keyed: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Adds range_id, the number of splitters at or below a record's key. The splitters are broadcast: MAX_RANGES at most."""
    slices: list[list] = [[] for _ in range(1 << SLICE_BITS)]
    for k, d, s in cuts:
        slices[_order((k, d, s))[0]].append({"k": k, "d": d, "s": s})
    below, rows = 0, []
    for i, cs in enumerate(slices):
        rows.append({"slice": i, "below": below, "cuts": cs})
        below += len(cs)
    schema = "array<struct<slice:int,below:int,cuts:array<struct<k:bigint,d:bigint,s:bigint>>>>"
    lookup = keyed.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    own = F.struct(F.col("k"), F.col("d"), F.col("s"))
    return (
        keyed.withColumn("slice", F.shiftrightunsigned("k", 64 - SLICE_BITS).cast("int"))
        .join(F.broadcast(lookup), "slice")
        .withColumn("range_id", F.col("below") + F.size(F.filter("cuts", lambda c: c <= own)))
        .drop("below", "cuts")
    )


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = 16, rows_per_range: int = 8192, samples_per_range: int = 16, keep_together: float = 0.01, seed: int = 7
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, range_id of every record of ``docs`` (doc_id, text).

    keep_together: a group of equal texts of up to this part of a shard stays in one shard; larger groups are divided.
    """
    keyed = written(_record_keys(docs), "shard-keys")
    total = keyed.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total.n:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint, range_id int")
    n_ranges = min(MAX_RANGES // 2, max(ranges_per_shard * n_shards, -(-total.n // rows_per_range)))
    cuts = _cuts(_draw(keyed, n_ranges * samples_per_range / total.b, seed), n_ranges)
    placed = _range_of(keyed, cuts)
    # Ranges of more than three times their due get denser splitters of their own.
    due = total.b / n_ranges
    full = placed.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.max("size").alias("most")).where(F.col("bytes") > F.lit(3 * due) + F.col("most"))
    overfull = {r.range_id: r.bytes for r in full.collect()}
    if overfull:
        within = placed.where(F.col("range_id").isin(list(overfull)))
        more = _draw(within.select("k", "d", "s", "size"), samples_per_range / due, seed + 1)
        extra = min(MAX_RANGES // 2, int(sum(overfull.values()) / due) + 1)
        cuts = sorted({*cuts, *_cuts(more, extra)}, key=_order)
        placed = _range_of(keyed, cuts)
    placed = written(placed, "shard-ranges")

    sums = placed.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    offsets, b, n = [], 0, 0
    for r in sorted(sums, key=lambda r: r.range_id):
        offsets.append({"range_id": r.range_id, "b0": b, "n0": n})
        b, n = b + r.bytes, n + r.rows
    starts = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(offsets)), "array<struct<range_id:int,b0:bigint,n0:bigint>>")))

    in_order = Window.partitionBy("range_id").orderBy("slice", "k", "d", "s")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range_id", "k")
    start = F.col("b0") + F.sum("size").over(so_far) - F.col("size")
    ranked = placed.join(F.broadcast(starts), "range_id").withColumns({"start": start, "at": F.col("n0") + F.row_number().over(in_order) - 1})
    ranked = ranked.withColumns({"group_start": F.min("start").over(group), "group_bytes": F.sum("size").over(group)})
    point: Column = F.when(F.col("group_bytes") <= F.lit(keep_together * total.b / n_shards), F.col("group_start")).otherwise(F.col("start"))
    shard = F.least(F.lit(n_shards - 1), F.floor(point * F.lit(n_shards) / F.lit(total.b))).cast("int")
    ranked = written(ranked.select("doc_id", "size", "text_crc32", shard.alias("shard"), "at", "range_id"), "shard-placed")

    first = ranked.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"), "range_id")
