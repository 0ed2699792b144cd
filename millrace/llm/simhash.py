r"""Near-duplicate detection by SimHash fingerprints and a binary-trie self-join.

Texts are lower-cased in A-Z, split into words ``[^\x20\x09-\x0D]+`` and read as word shingles. A fingerprint bit is set
if it is set in over half of the shingles' XXH64 hashes. Fingerprints that differ in at most ``max_bits`` bits are linked.

With max_bits + 1 disjoint groups of bits, two linked fingerprints agree in one group at least. Fingerprints are dealt by
(group, its bits); inside each bucket a binary trie of the other bits is joined with itself: pairs of nodes go down
together, each adds its differing bits to the pair's error, and pairs over the budget are dropped. A pair of nodes whose
members already are in one component is dropped as well, so a ball of many close fingerprints costs no quadratic work and
each bucket returns a spanning forest, never all its pairs. Buckets of very many fingerprints are cut into chunks, and each
pair of chunks is a bucket of its own. Keys of very many rows (a hot fingerprint, a text of many copies, the hub of a large
component) meet what belongs to them by broadcast, so none of them is one task's work.

Defined results: null and blank texts have fingerprint 0 and are linked like any other; texts of fewer words than a
shingle count as one shingle; repeated rows are separate documents of one fingerprint; a null doc_id is never a component's
id unless all are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.workers import given_back
from millrace.session import scratch, written

SEED = 42
MAX_BITS = 4
#: Most fingerprints of a bucket that one task joins; larger buckets are cut.
BUCKET_ROWS = 200_000
#: Shingles hashed before their bits are counted.
_STEP = 1 << 15


def fingerprint(text: str | None, n_words: int = 4) -> int:
    """The 64-bit fingerprint of a whole text as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) < n_words:
        starts, ends = [0], [len(joined)]
    n = max(1, len(words) - n_words + 1)
    ends = ends[-n:]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _STEP):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i : min(n, i + _STEP)], ends[i : i + _STEP], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, n_words: int = 4) -> DataFrame:
    """doc_id, fp (long) of every row."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, n_words) for t in batch], dtype="int64")

    return docs.select("doc_id", fp("text").alias("fp"))


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; a label is the smallest member's index."""
    while len(i):
        a, b = label[i], label[j]
        m = np.minimum(a, b)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        rest = label[i] != label[j]
        i, j = i[rest], j[rest]


def _product(lo1, n1, lo2, n2):
    """All index pairs of node pairs, by row."""
    n = n1 * n2
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return lo1[at] + k // n2[at], lo2[at] + k % n2[at]


def _equal_leaf(label, bits, lo1, hi1, lo2, hi2, max_bits, settle) -> None:
    """Joins two ranges of equal bits each: a member at a time with those that aren't linked to it yet."""
    if np.bitwise_count(bits[lo1] ^ bits[lo2]) > max_bits:
        return
    for i in range(lo1, hi1):
        first = max(lo2, i + 1) if lo1 == lo2 else lo2
        j = first + np.flatnonzero(label[first:hi2] != label[i])
        if len(j):
            settle(label, np.full(len(j), i), j)
        elif (label[lo1:hi1] == label[i]).all() and (label[lo2:hi2] == label[i]).all():
            return


def trie_self_join(bits: np.ndarray, group: np.ndarray, max_bits: int = MAX_BITS, small: int = 32, step: int = 200_000, settle=_settle) -> np.ndarray:
    """Component labels of ``bits`` (uint64, sorted within the sorted ``group``): members of a group that differ in at most
    max_bits bits are linked. Labels are indices into ``bits``. settle(label, i, j) joins the components of such pairs, or of
    those among them that pass its own check."""
    n = len(bits)
    label = np.arange(n)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if n else np.array([0])
    lo, hi = edge[:-1], edge[1:]
    # A pair of nodes: both ranges of the sorted bits and the differing bits so far. A node with itself has equal ranges.
    work = [(0, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    while work:
        depth, lo1, hi1, lo2, hi2, err = work.pop()
        if len(lo1) > step:
            for s in range(0, len(lo1), step):
                work.append((depth, *(x[s : s + step] for x in (lo1, hi1, lo2, hi2, err))))
            continue
        own = lo1 == lo2
        live = (hi1 > lo1) & (hi2 > lo2) & (err <= max_bits) & ~(own & (hi1 - lo1 < 2))
        # Drop pairs that lie in one component already.
        turns = np.r_[0, np.cumsum(label[1:] != label[:-1])] if n else np.zeros(1, dtype=np.int64)
        one = np.zeros(len(lo1), dtype=bool)
        k = np.flatnonzero(live)
        one[k] = (turns[hi1[k] - 1] == turns[lo1[k]]) & (turns[hi2[k] - 1] == turns[lo2[k]]) & (label[lo1[k]] == label[lo2[k]])
        live &= ~one
        lo1, hi1, lo2, hi2, err, own = (x[live] for x in (lo1, hi1, lo2, hi2, err, own))
        if not len(lo1):
            continue
        leaf = (hi1 - lo1) * (hi2 - lo2) <= small
        if depth == 64:
            wide = ~leaf
            for x in zip(lo1[wide], hi1[wide], lo2[wide], hi2[wide], strict=True):
                _equal_leaf(label, bits, *x, max_bits, settle)
            lo1, hi1, lo2, hi2, err, own = (x[leaf] for x in (lo1, hi1, lo2, hi2, err, own))
            leaf = leaf[leaf]
        if leaf.any():
            i, j = _product(lo1[leaf], (hi1 - lo1)[leaf], lo2[leaf], (hi2 - lo2)[leaf])
            near = (np.bitwise_count(bits[i] ^ bits[j]) <= max_bits) & (i != j)
            settle(label, i[near], j[near])
            lo1, hi1, lo2, hi2, err, own = (x[~leaf] for x in (lo1, hi1, lo2, hi2, err, own))
        if not len(lo1):
            continue
        zeros = np.r_[0, np.cumsum((bits >> np.uint64(63 - depth)) & np.uint64(1) == 0)]
        mid1, mid2 = lo1 + zeros[hi1] - zeros[lo1], lo2 + zeros[hi2] - zeros[lo2]
        two = ~own
        nxt = (
            np.r_[lo1, mid1, lo1, mid1[two]],
            np.r_[mid1, hi1, mid1, hi1[two]],
            np.r_[lo2, mid2, mid2, lo2[two]],
            np.r_[mid2, hi2, hi2, mid2[two]],
            np.r_[err, err, err + 1, err[two] + 1].astype(np.int8),
        )
        work.append((depth + 1, *nxt))
    return label


def _windows(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the left, width) of max_bits + 1 groups of bits that make up all 64."""
    n = max_bits + 1
    cut = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _buckets(fps: DataFrame, max_bits: int) -> DataFrame:
    """bucket, fp, turned: each fingerprint once for each group of bits; ``turned`` has that group's bits first."""
    rows = []
    for g, (first, width) in enumerate(_windows(max_bits)):
        left = F.col("fp") if first == 0 else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
        rows.append(F.struct(F.lit(g).alias("g"), F.shiftrightunsigned(left, 64 - width).alias("v"), left.alias("turned")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("b")).select("fp", F.col("b.g").alias("g"), F.col("b.v").alias("v"), F.col("b.turned").alias("turned"))


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: edges of a forest in each bucket over distinct ``fps`` (fp)."""
    dealt = _buckets(fps, max_bits)
    # At most one bucket in BUCKET_ROWS fingerprints can be oversized; each is cut into chunks that meet in pairs.
    big = dealt.groupBy("g", "v").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select("g", "v", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("cuts"))
    dealt = dealt.join(big, ["g", "v"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    dealt = dealt.withColumn("c", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select(F.xxhash64("g", "v", F.least("c", "o"), F.greatest("c", "o")).alias("bucket"), "turned", "fp")
    return dealt.groupBy("bucket").agg(F.collect_list(F.struct("turned", "fp")).alias("m")).where(F.size("m") > 1).mapInArrow(_forests(max_bits), "a long, b long")


def _forests(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            flat = lists.flatten()
            turned = flat.field("turned").to_numpy(zero_copy_only=False).view(np.uint64)
            fp = flat.field("fp").to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            group = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((turned, group))
            label = trie_self_join(turned[order], group[order], max_bits)
            fp = fp[order]
            k = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[k]), pa.array(fp[label[k]])], ["a", "b"])

    return run


#: A key of more rows than this, and than this part of all rows, meets by broadcast: HOT_KEYS rows at most.
HOT_ROWS, HOT_KEYS = 500, 10_000


def join_unique(rows: DataFrame, ones: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``ones`` (unique ``key``, n: its number of rows among all ``total`` rows, ...)."""
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    many, few = F.broadcast(ones.where(hot).drop("n")), ones.where(~hot).drop("n")
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(few, key))


def _state(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two sums of 64-bit hashes."""
    h = [F.xxhash64("a", "b", F.lit(i)) for i in range(2)]
    return tuple(edges.agg(F.count("*"), F.sum(h[0].cast("decimal(38,0)")), F.bit_xor(h[1])).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of ``edges`` (a, b), for all nodes but the roots themselves.

    Alternating large-star and small-star steps; each step is a grouped minimum and a join.
    """
    with scratch(edges.sparkSession):
        edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        before = None
        while True:
            now = _state(edges)
            if now == before or not now[0]:
                return written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "components", keep=True)
            before = now
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
            large = join_unique(both, least, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
            large = written(large, "edges")
            lower = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
            small = join_unique(large, lower, "a", now[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            edges = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")


def near_duplicates(docs: DataFrame, n_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links reach."""
    prints = written(fingerprints(docs, n_words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(link_fingerprints(distinct.select("fp"), max_bits))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    size = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("prints")).first()
    of_print = written(join_unique(named.withColumnRenamed("n", "copies"), written(ids, "component-ids"), "root", size.prints).select("fp", "component_id", F.col("copies").alias("n")), "component-of")
    return join_unique(prints, of_print, "fp", size.rows).select("doc_id", "fp", "component_id")


_SIGNED = "doc long, same binary, fp long, map binary, least array<long>, prefix array<long>, shingles array<int>"
#: Least shingle hashes by which most similar texts meet first; what they miss (a chance of (1 - s)**4 at similarity s) meets by prefixes.
MEETING = 4
#: Texts, and bytes of their shingles, that meet in one bucket and are joined by one task; larger buckets are cut.
MEETING_ROWS, MEETING_BYTES = 20_000, 32 << 20
#: Texts of which hashes are held at a time.
SIGN_ROWS = 256
#: Members of a block of texts with a prefix shingle in common, of which candidates are made.
BLOCK_ROWS = 2_000
#: Bits of a text's parity map.
MAP_BITS = 1024
#: Texts from which common shingles are found, and the most of these; they only set the order in which prefixes are read.
SAMPLE, COMMON = 20_000, 100_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes], n_words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles."""
    shingles = [b" ".join(words[i : i + n_words]) for i in range(max(1, len(words) - n_words + 1))] if words else []
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), dtype=">u8").astype(np.uint64))


def prefix(h: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n hashes in an order that holds for all texts: by hash, and ``common`` ones
    (sorted) last, by rank. Two sets of at least that similarity share a member of their prefixes."""
    if not len(h):
        return h
    at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
    late = common[at] == h if len(common) else np.zeros(len(h), dtype=bool)
    ordered = np.r_[h[~late], h[late][np.argsort(rank[at[late]])]] if late.any() else h
    return ordered[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def signature(h: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """Fingerprint, least shingle hashes and the sorted distinct shingles (32 bits each) of a whole text's ``hashes``."""
    if not len(h):
        return 0, [], np.zeros(0, dtype=np.int32)
    ones = sum(np.unpackbits(h[i : i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), _STEP))
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True), h[:MEETING].view(np.int64).tolist(), np.unique((h >> np.uint64(32)).astype(np.uint32).view(np.int32))


def parity_map(shingles: np.ndarray) -> bytes:
    """MAP_BITS bits, each set if an odd number of the (32-bit) shingles falls on it."""
    count = np.bincount(shingles.view(np.uint32) >> np.uint32(32 - MAP_BITS.bit_length() + 1), minlength=MAP_BITS)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def _maps(column: pa.Array) -> np.ndarray:
    """Parity maps as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), MAP_BITS // 64)


def may_be_similar(x: np.ndarray, y: np.ndarray, nx, ny, similarity: float) -> np.ndarray:
    """Whether pairs of sets (their maps and sizes) can have the similarity. Each element that is in one set only changes one
    bit, so maps never differ in more bits than sets in elements: no similar pair is lost."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (nx + ny) + 1e-6


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _common(docs: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (sorted) that several of some SAMPLE different texts have, and their ranks, rarest first."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SIGN_ROWS):
                found = [hashes(words_of(t.as_py()), n_words).view(np.int64) for t in batch.column("text").slice(at, SIGN_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["key"])

    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").distinct()
    counts = some.mapInArrow(shingled, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - order).astype(np.int64)


def similar_documents(docs: DataFrame, n_words: int = 5, max_bits: int = 20, similarity: float = 0.8) -> DataFrame:
    """doc, keep of every row of ``docs`` (doc unique, text): keep is the least doc of its group of similar texts.

    Texts of equal words, but for the case of A-Z and white space, are one group. Texts of a Jaccard similarity of their shingles of at least ``similarity`` are linked. Most
    are found where texts share one of their least shingle hashes and differ in at most max_bits bits: a quick first search.
    All others meet by the prefixes of their shingles, which similar texts can't fail to share; pairs of which both already
    are in one component aren't looked at again.
    """
    with scratch(docs.sparkSession):
        return written(_similar(docs, n_words, max_bits, similarity), "similar-groups", keep=True)


def _similar(docs: DataFrame, n_words: int, max_bits: int, similarity: float) -> DataFrame:
    common, rank = _common(docs, n_words)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SIGN_ROWS):
                part = batch.slice(at, SIGN_ROWS)
                same, found, prefixes = [], [], []
                for t in part.column("text"):
                    words = words_of(t.as_py())
                    h = hashes(words, n_words)
                    same.append(hashlib.md5(b" ".join(words)).digest())
                    found.append(signature(h))
                    prefixes.append(prefix(h, common, rank, similarity).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(same, pa.binary()), pa.array([f for f, *_ in found], pa.int64()), pa.array([parity_map(s) for *_, s in found], pa.binary()),
                     pa.array([m for _, m, _ in found], pa.list_(pa.int64())), _lists(prefixes, np.int64), _lists([s for *_, s in found], np.int32)],
                    ["doc", "same", "fp", "map", "least", "prefix", "shingles"],
                )
        given_back()

    signed = written(docs.select("doc", "text").mapInArrow(sign, _SIGNED), "signatures")
    texts = signed.select("doc", "same")
    first = written(texts.groupBy("same").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "first-of-equal")
    same = written(join_unique(texts, first, "same", texts.count()).select("doc", "first"), "equal-texts")
    alone = same.where("doc = first").select("doc")
    with scratch(docs.sparkSession):
        met = signed.select("doc", F.size("shingles").cast("long").alias("n"), F.explode("least").alias("key")).join(alone, "doc", "left_semi")
        sizes = met.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n")).where("m > 1")
        sizes = sizes.select("key", F.ceil(F.greatest(F.col("m") / MEETING_ROWS, F.col("n") * 4 / MEETING_BYTES)).cast("int").alias("cuts"))
        # Each text is in one part of a bucket, dealt anew for each key; prefixes find what the parts keep from meeting.
        asked = written(met.join(sizes, "key").select("doc", F.xxhash64("key", F.pmod(F.xxhash64("doc", "key"), F.col("cuts"))).alias("bucket")), "meetings")
        buckets = signed.select("doc", "fp", "map", "shingles").join(asked, "doc").groupBy("bucket").agg(F.collect_list(F.struct("doc", "fp", "map", "shingles")).alias("m")).select("m")
        quick = components(buckets.mapInArrow(_verified(max_bits, similarity), "a long, b long"))
        rooted = written(alone.join(quick, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("root", "doc").alias("root")), "quick-roots", keep=True)
    with scratch(docs.sparkSession):
        missed = written(_missed(signed, rooted, similarity), "missed-links", keep=True)
    from_, to = (rooted.select(F.col("doc").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    merged = components(missed.join(from_, "a").join(to, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    kept = rooted.join(merged.toDF("root", "least"), "root", "left").select(F.col("doc").alias("first"), F.coalesce("least", "root").alias("keep"))
    copies = same.groupBy("first").agg(F.count("*").alias("n"))
    return join_unique(same, written(kept.join(copies, "first"), "kept"), "first", same.count()).select("doc", "keep")


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def _missed(signed: DataFrame, rooted: DataFrame, similarity: float) -> DataFrame:
    """a, b: all similar texts of different roots (doc, root) that share a shingle of their prefixes."""
    known = signed.select("doc", "prefix").join(rooted, "doc")
    # Rows of a key meet once: which keys several roots share is found where the rows are, and what is wide comes after.
    # An array, so that both uses of the rows read the same columns and the second takes the first one's exchange.
    met = known.select("doc", "root", F.posexplode("prefix").alias("pos", "key"))
    met = met.select("key", F.array("doc", "root", F.col("pos").cast("long")).alias("x")).repartition("key")
    shared = met.groupBy("key").agg(F.min(F.get("x", F.lit(1))).alias("r"), F.max(F.get("x", F.lit(1))).alias("s"), F.count("*").alias("m")).where("r < s")
    asked = met.join(shared.select("key", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("cuts")), "key")
    asked = written(asked.select("key", F.get("x", F.lit(0)).alias("doc"), F.get("x", F.lit(2)).cast("int").alias("pos"), "cuts"), "shared-shingles")
    of_doc = signed.select("doc", F.size("shingles").alias("n"), "map").join(rooted, "doc")
    asked = asked.join(of_doc, "doc").withColumn("c", F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    asked = asked.groupBy("key", F.least("c", "o").alias("c"), F.greatest("c", "o").alias("o")).agg(F.collect_list(F.struct("doc", "root", "n", "pos", "map")).alias("m"))
    pairs = written(asked.select("m").mapInArrow(_candidates(similarity), "a long, b long").distinct(), "candidates")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    sets = written(signed.select("doc", "shingles").join(wanted, "doc"), "wanted-shingles")
    both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    # Row by row: a batch of pairs of long texts could be larger than a worker's memory.
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(shared / (F.size("s") + F.size("t") - shared) >= similarity).select("a", "b")


def _candidates(similarity: float):
    """Pairs of different roots that can still be similar by their sizes, by what follows their shared shingle and by their
    parity maps. The bound is that of the first shared shingle, so a similar pair passes in that one's group at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("m"):
                flat = members.values
                doc, root, n, pos = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("doc", "root", "n", "pos"))
                order = np.argsort(doc)
                maps = _maps(flat.field("map"))[order]
                doc, root, n, pos = doc[order], root[order], n[order].astype(np.int64), pos[order].astype(np.int64)
                for i in range(len(doc) - 1):
                    rest = slice(i + 1, None)
                    need = np.ceil(similarity / (1 + similarity) * (n[i] + n[rest]) - 1e-6) - 1  # 32-bit shingles may hide one
                    left = np.minimum(n[i] - pos[i], n[rest] - pos[rest])
                    j = i + 1 + np.flatnonzero((root[rest] != root[i]) & (np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]) - 1) & (left >= need))
                    b = doc[j[may_be_similar(maps[j], maps[i], n[j], n[i], similarity)]]
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), doc[i])), pa.array(b)], ["a", "b"])
        given_back()

    return run


def _verified(max_bits: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("m"):
                flat = members.values
                doc = flat.field("doc").to_numpy(zero_copy_only=False)
                fp = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                lists = flat.field("shingles")
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                order = np.argsort(fp, kind="stable")
                sets = [values[ends[i] : ends[i + 1]] for i in order.tolist()]
                maps, n = _maps(flat.field("map"))[order], np.diff(ends)[order]

                def check(label, i, j, sets=sets, maps=maps, n=n):
                    near = np.flatnonzero((label[i] != label[j]) & may_be_similar(maps[i], maps[j], n[i], n[j], similarity))
                    i, j = i[near], j[near]
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        s, t = sets[x], sets[y]
                        if label[x] != label[y] and min(len(s), len(t)) >= similarity * max(len(s), len(t)) and jaccard(s, t) >= similarity:
                            _settle(label, np.array([x]), np.array([y]))

                label = trie_self_join(fp[order], np.zeros(len(order), dtype=np.int64), max_bits, settle=check)
                doc = doc[order]
                k = np.flatnonzero(label != np.arange(len(label)))
                a.append(doc[k])
                b.append(doc[label[k]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])
        given_back()

    return run


def hex_of(fp) -> F.col:
    """16 lowercase hex digits of a long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
