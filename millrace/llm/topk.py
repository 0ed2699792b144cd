"""Exact top-k search by distributed histogram selection.

Rows are dealt once into parts. In every round the queries, in blocks, go to all parts, and each part gives one histogram a
query: how many of its scores fall into equal bins of the range where the query's k-th score must lie. The sums of the parts
tell the bin of the k-th score, which becomes the next range. When few enough scores are left at or above the range, they are
returned and ranked.

Scores are integers: components become floor(scale * x). Products are summed in doubles while no partial sum can reach
2**53, and in Python integers beyond that.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as
padded with zeros; scores beyond 64 bits count as the least or greatest 64-bit integer; ties go to the smaller id; rows of
one id count separately (a query's own id is never its candidate); a null id takes no part; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Rows in a part at most, about, and queries that visit it at a time: what a task holds.
PART_ROWS, QUERY_BLOCK = 131_072, 8192
#: Bytes of a part's or a block's vectors at most, about.
PART_BYTES = 128 << 20
#: Rows and queries that are multiplied at a time.
ROW_STEP, QUERY_STEP = 2048, 1024
#: Bins of a round's histogram.
BINS = 64
#: Selection stops when at most this many scores a query are at or above its range.
ENOUGH = 64
_SPAN = np.iinfo(np.int64)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """id, v: the usable vectors, each component x as floor(scale * x)."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = df.where(x.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c)  # noqa: E731  larger doubles are integers
    return ok.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: whole(c.cast("double") * scale)).alias("v"))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = vectors.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), width))
    out[np.arange(width)[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*tables: pa.Table) -> int:
    return max([1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables)])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = np.finfo(np.float64).max
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    a, b = ([[int(min(max(x, -most), most)) for x in u] for u in m] for m in (a, b))
    exact = [[min(max(sum(x * y for x, y in zip(u, w, strict=True)), _SPAN.min), _SPAN.max) for w in b] for u in a]
    return np.array(exact, dtype=np.int64).reshape(len(a), len(b))


def _scores(queries: pa.Table, rows: pa.Table):
    """(positions of some queries, ids of some rows, their scores, which of the scores count) over all of both."""
    width = _width(queries, rows)
    a, b = _matrix(queries.column("v"), width), _matrix(rows.column("v"), width)
    qid, rid = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    for i in range(0, len(a), QUERY_STEP):
        at = np.arange(i, min(len(a), i + QUERY_STEP))
        for j in range(0, len(b), ROW_STEP):
            ids = rid[j : j + ROW_STEP]
            yield at, ids, _products(a[at], b[j : j + ROW_STEP]), qid[at][:, None] != ids[None, :]


def _answer(queries: pa.Table, at: np.ndarray, **columns: pa.Array) -> pa.Table:
    """Columns of queries at positions, beside others."""
    return pa.table({"id": queries.column("id").take(pa.array(at)), "copy_no": queries.column("copy_no").take(pa.array(at)), **columns})


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``rows`` (id, v) for each of ``queries`` (id, v)."""
    spark = rows.sparkSession
    queries, rows = written(queries, "topk-queries"), written(rows, "topk-rows")
    sized = [df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first() for df in (queries, rows)]
    (n_q, n_r), width = (x.n for x in sized), max(x.width for x in sized)
    held = max(1, PART_BYTES // (8 * max(1, width)))
    parts = max(1, min(n_r, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_r // min(PART_ROWS, held)))))
    blocks = max(1, -(-n_q // min(QUERY_BLOCK, held)))
    number = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Pairs of a part and a query block are the groups, never pairs of rows.
    # Rows are dealt by their place in the written table, so those of one id don't meet.
    dealt = rows.withColumn("part", number(parts, F.monotonically_increasing_id())).withColumn("block", every(blocks)).groupBy("part", "block")

    def visits(state: DataFrame):
        return state.withColumn("block", number(blocks, "id", "copy_no")).withColumn("part", every(parts)).groupBy("part", "block").cogroup(dealt)

    def ends(q: pa.Table, r: pa.Table) -> pa.Table:
        lo, hi, n = np.full(len(q), _SPAN.max), np.full(len(q), _SPAN.min), np.zeros(len(q), dtype=np.int64)
        for at, _, s, counted in _scores(q, r):
            lo[at] = np.minimum(lo[at], np.where(counted, s, _SPAN.max).min(1, initial=_SPAN.max))
            hi[at] = np.maximum(hi[at], np.where(counted, s, _SPAN.min).max(1, initial=_SPAN.min))
            n[at] += counted.sum(1)
        some = np.flatnonzero(n)
        return _answer(q, some, lo=pa.array(lo[some]), hi=pa.array(hi[some]), n=pa.array(n[some]))

    def counts(q: pa.Table, r: pa.Table) -> pa.Table:
        lo, hi, step = (q.column(c).to_numpy() for c in ("lo", "hi", "step"))
        bins = np.zeros((len(q), BINS), dtype=np.int64)
        for at, _, s, counted in _scores(q, r):
            inside = counted & (s >= lo[at][:, None]) & (s <= hi[at][:, None])
            # Unsigned, so that a range of all 64 bits has no overflow.
            place = (s.view(np.uint64) - lo[at].view(np.uint64)[:, None]) // step[at].view(np.uint64)[:, None]
            flat = (np.arange(len(at))[:, None] * BINS + place.astype(np.int64))[inside]
            bins[at] += np.bincount(flat, minlength=len(at) * BINS).reshape(-1, BINS)
        some = np.flatnonzero(bins.any(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BINS), pa.array(bins[some].ravel()))
        return _answer(q, some, bins=lists)

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        lo = q.column("lo").to_numpy()
        held = [np.zeros(0, dtype=np.int64)] * 3
        for at, ids, s, counted in _scores(q, r):
            x, y = np.nonzero(counted & (s >= lo[at][:, None]))
            found = [np.r_[a, b] for a, b in zip(held, (at[x], s[x, y], ids[y]), strict=True)]
            order = np.lexsort((found[2], ~found[1], found[0]))  # ~s falls as s rises
            found = [c[order] for c in found]
            # Of many ties a part passes on the k that can still win.
            keep = np.arange(len(order)) - np.searchsorted(found[0], found[0]) < k
            held = [c[keep] for c in found]
        return _answer(q, held[0], vec_id=pa.array(held[2]), score=pa.array(held[1]))

    # Repeated query rows are told apart by their number within the id.
    numbered = queries.withColumn("copy_no", F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("long"))
    key = ["id", "copy_no"]
    span = visits(numbered).applyInArrow(ends, "id long, copy_no long, lo long, hi long, n long").groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("left"))
    # A bin's width; the division comes first where the whole range may not fit 64 bits.
    step = F.expr(f"CASE WHEN lo >= 0 OR hi < 0 OR (hi < {2**62} AND lo > -{2**62}) THEN (hi - lo) div {BINS} + 1 ELSE hi div {BINS} - lo div {BINS} + 2 END")
    # above: the number of scores over the range; left: of those at or over its lower end.
    state = written(numbered.join(span, key).withColumns({"above": F.lit(0).cast("long"), "step": step}), "topk-state")
    undecided = (F.col("left") > max(ENOUGH, k)) & (F.col("hi") > F.col("lo"))
    while not state.where(undecided).isEmpty():
        sums = visits(state.where(undecided)).applyInArrow(counts, "id long, copy_no long, bins array<long>")
        sums = sums.groupBy(*key).agg(F.array(*[F.sum(F.col("bins")[i]) for i in range(BINS)]).alias("bins"))
        state = written(_narrowed(state.join(sums, key, "left"), k).withColumn("step", step), "topk-state")
    found = visits(state).applyInArrow(best, "id long, copy_no long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _narrowed(state: DataFrame, k: int) -> DataFrame:
    """The state with its range narrowed to the bin of the k-th score; queries without ``bins`` stay as they are."""
    # From the highest bin down: the first one with which k scores are reached.
    at = F.aggregate(
        F.reverse("bins"),
        F.struct(F.col("above").alias("above"), F.lit(BINS).alias("bin"), F.lit(None).cast("long").alias("m")),
        lambda acc, m: F.when(acc["above"] + F.coalesce(acc["m"], F.lit(0).cast("long")) >= k, acc).otherwise(
            F.struct((acc["above"] + F.coalesce(acc["m"], F.lit(0).cast("long"))).alias("above"), (acc["bin"] - 1).alias("bin"), m.alias("m"))
        ),
    )
    moved = F.col("bins").isNotNull()
    state = state.withColumn("at", at)
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  sums can pass 64 bits on the way
    low = wide("lo") + wide("at.bin") * wide("step")
    lo, hi = low.cast("long"), F.least(wide("hi"), low + wide("step") - 1).cast("long")
    return state.select(
        "id",
        "copy_no",
        "v",
        F.when(moved, lo).otherwise(F.col("lo")).alias("lo"),
        F.when(moved, hi).otherwise(F.col("hi")).alias("hi"),
        F.when(moved, F.col("at.above") + F.col("at.m")).otherwise(F.col("left")).alias("left"),
        F.when(moved, F.col("at.above")).otherwise(F.col("above")).alias("above"),
    )
