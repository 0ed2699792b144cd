"""Best-fit packing of documents into training sequences under conflicts.

Documents go into bins of ``capacity`` units (UTF-8 bytes of the text). A bin holds no two documents of one source and no two
of one duplicate cluster (equal texts after folding case and white space). A document longer than a bin first fills bins of
its own; its rest is packed like any other document.

Documents are dealt at random into packs of a bounded number of units, so that hot sources and clusters spread over all
packs, and every pack is filled on its own, largest first: open bins are kept in the order of their residual space, each with
bitmaps of the sources and clusters it holds; from the tightest bin that has room the search goes on to the next one until a
compatible bin is found, and a new bin is opened if none is. Bins stand in blocks that hold what all of their bitmaps have in
common, so that a run of bins which all conflict is passed in one step. The number of packs follows from the table alone.

Defined results: null texts and sources count as empty ones; an empty text takes part with no units; repeated rows are
documents of their own (of one cluster); ties go by doc_id (null first), then text hash; ids of any size and null ids come
back as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.simhash import HOT_KEYS, HOT_ROWS
from millrace.session import written

CAPACITY = 8192
#: Units in a pack: what one task holds at a time are sizes and ids of this many units' documents.
PACK_UNITS = 4 << 20
#: Documents in a pack, at most about this many (short documents).
PACK_ROWS = 4_000
#: Bins in a block, at most twice this many.
BLOCK = 48


class Bins:
    """Open bins in the order of (residual, age), in blocks with the bits that all bins of a block have set."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.blocks: list[list[tuple[int, int]]] = [[]]
        self.last: list[tuple[int, int]] = [(capacity + 1, 0)]  # no smaller than a block's greatest entry
        self.shared: list[tuple[int, int] | None] = [None]  # common bits of sources and clusters; None: to be counted

    def _common(self, k: int) -> tuple[int, int]:
        s = c = -1
        for _, b in self.blocks[k]:
            s &= self.sources[b]
            c &= self.clusters[b]
        self.shared[k] = (s, c)
        return s, c

    def _insert(self, entry: tuple[int, int]) -> None:
        k = min(bisect_left(self.last, entry), len(self.blocks) - 1)
        block = self.blocks[k]
        block.insert(bisect_left(block, entry), entry)
        if self.shared[k] is not None:
            s, c = self.shared[k]
            self.shared[k] = (s & self.sources[entry[1]], c & self.clusters[entry[1]])
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.last[k : k + 1] = [block[BLOCK - 1], self.last[k]]
            self.shared[k : k + 1] = [None, None]

    def _take(self, units: int, s: int, c: int) -> tuple[int, int] | None:
        """Takes out the first entry with room that holds neither bit."""
        k = bisect_left(self.last, (units, -1))
        while k < len(self.blocks):
            block = self.blocks[k]
            if block:
                have = self.shared[k] or self._common(k)
                if not (have[0] & s or have[1] & c):
                    for at in range(bisect_left(block, (units, -1)), len(block)):
                        b = block[at][1]
                        if not (self.sources[b] & s or self.clusters[b] & c):
                            self.shared[k] = None
                            return block.pop(at)
            k += 1
        return None

    def place(self, units: int, source: int, cluster: int) -> int:
        """The bin of an item: the tightest compatible one, or a new one. Cluster number 0 conflicts with nothing."""
        s, c = 1 << source, (1 << cluster) & ~1
        found = self._take(units, s, c)
        if found is None:
            found = (self.capacity, len(self.sources))
            self.sources.append(0)
            self.clusters.append(0)
        residual, b = found
        self.sources[b] |= s
        self.clusters[b] |= c
        self._insert((residual - units, b))
        return b


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each item (units, source number, cluster number), in the order in which items are placed."""
    bins = Bins(capacity)
    return [bins.place(*item) for item in items]


def _numbered(values: list) -> list[int]:
    seen: dict = {}
    return [seen.setdefault(v, len(seen)) for v in values]


def _cluster_numbers(values: list) -> list[int]:
    """Numbers of clusters from 1; documents that are alone in theirs have 0."""
    count = Counter(values)
    seen: dict = {}
    return [seen.setdefault(v, len(seen) + 1) if count[v] > 1 else 0 for v in values]


_PACKED = "doc_id long, part int, units long, source string, cluster long, pack int, bin int, place int"


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, part, units, source, cluster, pack, bin, place: each document's parts with the bin of each and its place there.

    Bins are numbered within their pack; (pack, bin) names a sequence.
    """
    text = F.coalesce("text", F.lit(""))
    folded = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("size"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(folded).alias("cluster"), F.xxhash64(text).alias("own"))
    rows = written(rows.withColumns({"same": F.xxhash64("doc_id", "own", F.lit(3)), "row": F.monotonically_increasing_id()}), "pack-sizes")
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    packs = max(1, -(-(total.b or 0) // PACK_UNITS), -(-total.n // PACK_ROWS))
    # Rows that are repeated very often go to all packs; at most HOT_KEYS are, as each has more than this part of all rows.
    hot = rows.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_ROWS, total.n // HOT_KEYS)).select("same", F.lit(True).alias("hot"))
    spread = rows.join(F.broadcast(hot), "same", "left")
    key = F.when(F.col("hot"), F.xxhash64("same", "row")).otherwise(F.col("same"))
    rows = spread.select("doc_id", "size", "source", "cluster", "own", F.pmod(key, F.lit(packs)).cast("int").alias("pack"))

    def fill(pack: pa.Table) -> pa.Table:
        size = pack.column("size").to_numpy()
        rest = np.where((size > 0) & (size % capacity == 0), capacity, size % capacity)
        pack = pack.append_column("rest", pa.array(rest, pa.int64()))
        order = pc.sort_indices(pack, [("rest", "descending"), ("doc_id", "ascending"), ("own", "ascending")], null_placement="at_start")
        pack = pack.take(order)
        rest, sources, clusters = (pack.column(c).to_pylist() for c in ("rest", "source", "cluster"))
        full = ((pack.column("size").to_numpy() - np.array(rest, dtype=np.int64)) // capacity).astype(np.int64)
        bins = np.array(best_fit(list(zip(rest, _numbered(sources), _cluster_numbers(clusters), strict=True)), capacity), dtype=np.int64)
        # A document is its full parts, which have bins of their own, and its rest.
        row = np.repeat(np.arange(len(full)), full + 1)
        part = np.arange(len(row)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
        whole = part < full[row]
        where = bins[row]
        where[whole] = bins.max(initial=-1) + 1 + np.arange(whole.sum())
        units = np.where(whole, capacity, np.array(rest, dtype=np.int64)[row])
        by_bin = np.argsort(where, kind="stable")
        first = np.r_[True, where[by_bin][1:] != where[by_bin][:-1]] if len(row) else np.zeros(0, dtype=bool)
        place = np.empty(len(row), dtype=np.int32)
        at = np.arange(len(row))
        place[by_bin] = at - np.maximum.accumulate(np.where(first, at, 0))
        taken = pack.take(pa.array(row))
        columns = [taken.column("doc_id"), pa.array(part, pa.int32()), pa.array(units, pa.int64()), taken.column("source"), taken.column("cluster"), taken.column("pack"), pa.array(where, pa.int32()), pa.array(place)]
        return pa.table(columns, names=[c.split()[0] for c in _PACKED.split(", ")])

    return rows.groupBy("pack").applyInArrow(fill, _PACKED)


def sequences(packed: DataFrame) -> DataFrame:
    """pack, bin, used, docs: every bin with its units and its (doc_id, part) in order; a bin is bounded by its capacity."""
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id", "part"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["part"].alias("part")))
    return packed.groupBy("pack", "bin").agg(F.sum("units").alias("used"), in_order.alias("docs"))
