"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine checks and connected components.

Vectors that are equal are one class from the start. In each of several tables a class is dealt to the bucket named by the
signs of its products with the table's random hyperplanes. Two vectors at an angle a get one sign each with a chance of
1 - a / pi, so the number of tables follows from the number of signs: enough that a pair just at the least cosine shares a
bucket in one table at least with the chance RECALL; closer pairs share one almost surely.

1. Each bucket is compared in double precision, and gives a spanning forest of its links, never all its pairs. Buckets of
   very many classes are cut into chunks, and each pair of chunks is a bucket of its own.
2. Connected components of the forests. All found links lie inside components.
3. Links are counted inside components, so each pair counts once however many tables it met in, and a pair that no table
   brought together counts as well if others connect it. Members within half the greatest angle of the component's first
   vector (its core) are all linked to each other by the triangle inequality, so a large group of near copies is counted
   without looking at its pairs; only pairs with a member outside the core are compared, in blocks.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component link with nothing and are
their own component; a shorter vector counts as padded with zeros; equal vectors link (each row with all others); rows of
one id count separately; a null id is never a component's id unless all its ids are null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.simhash import _settle, components, join_unique
from millrace.session import scratch, written

COSINE = 0.9
#: Chance that a pair at the least cosine meets in some table. Classes in a bucket on average, if signs were even.
RECALL, BUCKET = 0.97, 512
#: Most classes of a bucket or component that one task compares, and bytes of their vectors; more are cut into chunks.
CHUNK_ROWS, CHUNK_BYTES = 8192, 64 << 20
#: Rows compared with a chunk at a time.
STEP = 512
SEED = 42
#: What rounding may move an angle by.
SLACK = 1e-6


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a table, tables) for n classes."""
    signs = max(4, round(math.log2(max(1, n) / BUCKET)))
    met = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - met))


def _usable(v):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of length one, in doubles."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), width))
    out[np.arange(width)[None, :] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(1, keepdims=True, initial=np.finfo(float).tiny)  # squares of extreme components stay finite
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.finfo(float).tiny)


def _signed(width: int, signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((width, tables * signs))
        weight = np.int64(1) << np.arange(signs, dtype=np.int64)
        for batch in batches:
            sides = (units(batch.column("v"), width) @ planes >= 0).reshape(-1, tables, signs)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array((sides @ weight).ravel()))], ["cid", "v", "sides"])

    return run


def link_forest(vectors: np.ndarray, cosine: float) -> np.ndarray:
    """Labels (the smallest member's index) of the components of unit ``vectors`` by links of at least ``cosine``."""
    label = np.arange(len(vectors))
    for at in range(0, len(vectors), STEP):
        near = vectors[at : at + STEP] @ vectors[at:].T >= cosine
        i, j = np.nonzero(near & (label[at : at + STEP, None] != label[None, at:]))
        _settle(label, i + at, j + at)
    return label


def _chunked(df: DataFrame, *key: str, width: int, asked=None) -> DataFrame:
    """``df`` dealt to groups of at most two chunks of each key's rows; c is a row's own chunk, lo and hi those of the group."""
    most = min(CHUNK_ROWS, max(1, CHUNK_BYTES // (8 * width)))
    sizes = df.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > most).select(*key, F.ceil(F.col("m") / most).cast("int").alias("cuts"))
    # A key in most rows has more than `most` of them, so these are few; the join is by their size all the same.
    dealt = df.join(sizes, list(key), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return dealt.withColumns({"lo": F.least("c", "o"), "hi": F.greatest("c", "o")}).drop("o", "cuts")


def _links(classes: DataFrame, width: int, cosine: float, recall: float) -> DataFrame:
    """a, b: forests of links between ``classes`` (cid, v)."""
    signs, tables = tables_for(classes.count(), cosine, recall)
    signed = classes.select("cid", "v").mapInArrow(_signed(width, signs, tables), f"cid long, v {classes.schema['v'].dataType.simpleString()}, sides array<long>")
    dealt = _chunked(written(signed.select("cid", "v", F.posexplode("sides").alias("t", "side")), "sign-buckets"), "t", "side", width=width)

    def forest(group: pa.Table) -> pa.Table:
        cid = group.column("cid").to_numpy()
        order = np.argsort(cid)
        label = link_forest(units(group.column("v").combine_chunks(), width)[order], cosine)
        k = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": cid[order][k], "b": cid[order][label[k]]})

    return dealt.groupBy("t", "side", "lo", "hi").applyInArrow(forest, "a long, b long")


def _counted(members: DataFrame, width: int, cosine: float) -> DataFrame:
    """cid, links: rows linked to each class in ``members`` (cid, root, n, v), all of components of several classes."""
    angle = math.acos(cosine)
    total = members.count()
    firsts = members.where("cid = root").select("root", F.col("v").alias("first")).join(members.groupBy("root").agg(F.count("*").alias("n")), "root")

    def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with_first = (units(batch.column("v"), width) * units(batch.column("first"), width)).sum(1)
            core = np.arccos(np.clip(with_first, -1, 1)) <= angle / 2 - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cid", "root", "copies", "v")] + [pa.array(core)], ["cid", "root", "copies", "v", "core"])

    met = join_unique(members.withColumnRenamed("n", "copies"), firsts, "root", total).select("cid", "root", "copies", "v", "first")
    known = written(met.mapInArrow(cored, f"cid long, root long, copies long, v {members.schema['v'].dataType.simpleString()}, core boolean"), "component-cores")
    inside = known.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("heart"), F.sum((~F.col("core")).cast("long")).alias("outside"))
    inside = written(inside, "component-sums")
    sure = join_unique(known.select("cid", "root", "copies", "core"), inside, "root", total)
    sure = sure.select("cid", F.when(F.col("core"), F.col("heart") - 1).otherwise(F.col("copies") - 1).alias("links"))
    open_ = join_unique(known, inside.where("outside > 0").select("root", "n"), "root", total).select("cid", "root", "copies", "v", "core")

    def compared(group: pa.Table) -> pa.Table:
        cid, copies, core, c = (group.column(x).to_numpy() for x in ("cid", "copies", "core", "c"))
        v = units(group.column("v").combine_chunks(), width)
        own = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        links = np.zeros(len(cid), dtype=np.int64)
        out = np.flatnonzero(~core)
        for at in range(0, len(out), STEP):
            x = out[at : at + STEP]
            near = v[x] @ v.T >= cosine
            near[np.arange(len(x)), x] = False
            if not own:  # pairs inside a chunk are that chunk's own
                near &= c[x][:, None] != c[None, :]
            links[x] += near @ copies
            links += np.where(core, copies[x] @ near, 0)
        return pa.table({"cid": cid, "links": links})

    dealt = _chunked(open_, "root", width=width)
    more = dealt.groupBy("root", "lo", "hi").applyInArrow(compared, "cid long, links long")
    return sure.unionByName(more).groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``df``."""
    with scratch(df.sparkSession):
        return written(_near(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")), cosine, recall), "near-vectors", keep=True)


def _near(rows: DataFrame, cosine: float, recall: float) -> DataFrame:
    key = ["h1", "h2"]
    used = rows.where(_usable(F.col("v")))
    named = used.select("vec_id", "v", *[F.xxhash64(F.lit(i), "v").alias(k) for i, k in enumerate(key)])
    classes = named.groupBy(*key).agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(written(classes, "vectors").withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    roots = components(_links(classes, width, cosine, recall))
    grouped = written(classes.select(*key, "cid", "n", "least").join(roots, F.col("cid") == F.col("node"), "left").select(*key, "cid", "n", "least", F.coalesce("root", "cid").alias("root")), "vector-roots")
    of_root = written(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "vector-components")
    total = grouped.count()
    several = join_unique(grouped.withColumnRenamed("n", "copies"), of_root, "root", total)
    named_classes = written(several.select(*key, "cid", "root", "component_id", F.col("copies").alias("n")), "vector-named")
    many = named_classes.join(of_root.where("n > 1").select("root"), "root", "left_semi").select("cid", "root", "n")
    counted = _counted(written(many.join(classes.select("cid", "v"), "cid"), "component-members"), width, cosine)
    links = named_classes.join(counted, "cid", "left").select(*key, "component_id", "n", F.coalesce("links", F.col("n") - 1).alias("n_links"))
    linked = join_unique(named.select("vec_id", *key), written(links, "vector-links"), key, used.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where(~_usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
