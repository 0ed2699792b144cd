"""Removal of repeated byte strings by bucketed enhanced suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller doc_id, or the same document at an
earlier start) is marked. Matches never cross documents; strings are judged on the input.

1. Anchors. Of the ``gram``-byte strings inside a ``length``-byte string the one of least hash (the leftmost of ties) is its
   anchor, so equal strings have equal anchors at equal offsets. An anchor's context is all that such strings can hold: up
   to ``length - gram`` bytes on its left and ``length`` bytes from it on. About one byte in 35 is an anchor.
2. Anchors are dealt by their hash. Equal contexts are one leaf of the interval tree with all their occurrences; they are
   told by the 128 bits of two hashes, first inside each task, so that only the earliest is sent on, then where a hash meets.
   All but the earliest are covered. Hashes with very many different contexts are not dealt as contexts; each of their
   strings of ``length`` bytes is dealt by its own hash instead, of which again only the first per task is sent on.
3. Hashes with several leaves fetch the contexts' bytes and form a bucket: the suffixes that start at its anchors are sorted,
   their common-prefix intervals are found by a stack scan, and inside an interval left contexts tell which occurrences extend
   alike to the left. Every interval that is left diverse gives maximal repeats of at least ``length`` bytes with all their
   occurrences; all but the earliest are covered.

Defined results: null and empty texts have nothing to remove; rows of one doc_id count as documents in the order of their
texts (of equal rows one is the first); a null doc_id comes before all others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

LENGTH = 100
GRAM = 32
#: Different contexts of one hash beyond which its strings are dealt one by one, and the most such hashes (8 MB): the most
#: frequent ones, so that any other has at most 1 / MAX_HOT of all anchors.
HOT_CONTEXTS, MAX_HOT = 4096, 1_000_000
#: Anchors that a task holds before it settles them. Contexts of one hash among them are counted one by one from HELD_HOT on;
#: fewer are counted by a sample of one context in HELD_HOT, so a hash that is thinly spread over many tasks is found as well.
HELD, HELD_HOT = 1_000_000, 16
_CHUNK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_FIRST = -(2**63)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(base, -1, 2**64), dtype=np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """Hashes of any substrings of a buffer, from running sums of two polynomials."""

    def __init__(self):
        self.size = 0

    def load(self, buf: np.ndarray) -> None:
        if len(buf) + 1 > self.size:
            self.size = max(len(buf) + 1, 2 * _CHUNK)
            self.tables = [_powers(b, self.size) for b in _BASES]
        c = buf.astype(np.uint64) + np.uint64(1)
        self.sums = [np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(c * up[: len(c)])] for up, _ in self.tables]

    def grams(self, width: int) -> np.ndarray:
        s, down = self.sums[0], self.tables[0][1]
        return _mix((s[width:] - s[:-width]) * down[: len(s) - width])

    def spans(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s, down = self.sums[which], self.tables[which][1]
        return _mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """Buffers (from, to) of whole documents up to _CHUNK bytes, or parts of one longer document, with for each document
    (row, its first byte, first and last + 1 start of strings to look at). Parts overlap by the contexts' reach."""
    held: list[tuple[int, int, int, int]] = []
    first = None
    for row in range(len(offsets) - 1):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        if hi - lo < length:
            continue
        if held and hi - first > _CHUNK:
            yield first, last, held
            held = []
        if hi - lo > _CHUNK:
            for p in range(lo, hi - length + 1, _CHUNK):
                q = min(p + _CHUNK, hi - length + 1)
                yield max(lo, p - length), min(hi, q + 2 * length), [(row, lo, p, q)]
            continue
        if not held:
            first = lo
        held.append((row, lo, lo, hi - length + 1))
        last = hi
    if held:
        yield first, last, held


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, hasher: _Hasher | None = None) -> Iterator[tuple]:
    """For buffers of documents: row, pos (in the document), key, ctx, left, right of the anchors, and for each anchor the
    range of starts [p0, p1) of its strings with a function that hashes strings by start."""
    hasher = hasher or _Hasher()
    for b0, b1, docs in _pieces(offsets, length):
        buf = data[b0:b1]
        hasher.load(buf)
        keys = hasher.grams(gram)
        tagged = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
        least = (_window_min(tagged, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.concatenate([np.arange(p, q) for _, _, p, q in docs]) - b0
        row = np.repeat([d[0] for d in docs], [q - p for _, _, p, q in docs])
        at = least[starts]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        a, row = at[new], row[new]
        p0, p1 = starts[new], starts[np.r_[new[1:], len(starts)] - 1] + 1
        lo, hi = offsets[row] - b0, offsets[row + 1] - b0
        left, right = np.minimum(length - gram, a - lo), np.minimum(length, hi - a)
        ctx = hasher.spans(1, a - left, a + right) + np.uint64(3) * left.astype(np.uint64)
        yield row, a - lo, keys[a], ctx, left, right, p0, p1, lo, hasher


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals by document; touching ones are joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    change = np.r_[True, doc[1:] != doc[:-1]]
    lift = np.cumsum(change).astype(np.int64) << 34  # positions are below 2**33
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(change | np.r_[True, (start + lift)[1:] > reach[:-1]])
    return doc[new], start[new], (reach - lift)[np.r_[new[1:], len(doc)] - 1]


def _first_of_equal(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, ctx, doc, pos), and which rows in it are the first of their key and ctx."""
    order = np.lexsort((pos, doc, ctx, key))
    k, c = key[order], ctx[order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, dtype=bool)


_ANCHORS = "key long, ctx long, doc long, pack long"
_COVER, _BUCKET = 0, 1


def _pack(pos, left, right):
    return (pos.astype(np.int64) << 14) | (left.astype(np.int64) << 7) | right.astype(np.int64)


def _unpack(pack):
    return pack >> 14, (pack >> 7) & 127, pack & 127


class _Settler:
    """Collects a task's anchors and settles what it has seen twice itself."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, key, ctx, doc, pos, left, right) -> None:
        self.parts.append((key.view(np.int64), ctx.view(np.int64), doc, pos, left, right))
        self.n += len(key)

    def settle(self):
        """(key, ctx, doc, pos, left, right) of the firsts, and merged intervals (doc, start, end) of all others."""
        key, ctx, doc, pos, left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*self.parts, strict=True) if self.parts else [[]] * 6))
        self.parts, self.n = [], 0
        order, first = _first_of_equal(key, ctx, doc, pos)
        again = order[~first]
        covered = _merged(doc[again], pos[again] - left[again], pos[again] + right[again])
        keep = order[first]
        return tuple(x[keep] for x in (key, ctx, doc, pos, left, right)), covered


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The doc column, all text bytes and the texts' offsets of an Arrow batch."""
    doc, text = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1 + text.offset)[text.offset :]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    return doc, data, offsets


def _scan(length: int, gram: int, hot: np.ndarray | None):
    """Tasks over texts. Without ``hot``: the hashes with many contexts. With it: anchors to deal, and covered intervals."""

    def emit(settler: _Settler):
        (key, ctx, doc, pos, left, right), (d, s, e) = settler.settle()
        if hot is None:
            if len(key):
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                n = np.diff(np.r_[at, len(key)])
                drawn = np.add.reduceat((ctx.view(np.uint64) % np.uint64(HELD_HOT) == 0).astype(np.int64), at)
                n = np.where(n >= HELD_HOT, n, HELD_HOT * drawn)
                many = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(key[at][many]), pa.array(n[many])], ["key", "n"])
            return
        for a in range(0, len(key), 100_000):
            x = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(ctx[x]), pa.array(doc[x]), pa.array(_pack(pos[x], left[x], right[x]))], ["key", "ctx", "doc", "pack"])
        for a in range(0, len(d), 100_000):
            x = slice(a, a + 100_000)
            # Intervals travel with the anchors, dealt by document; a negative pack tells them apart.
            yield pa.RecordBatch.from_arrays([pa.array(_mix(d[x].view(np.uint64)).view(np.int64)), pa.array(s[x]), pa.array(d[x]), pa.array(-1 - e[x])], ["key", "ctx", "doc", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settler, hasher = _Settler(), _Hasher()
        for batch in batches:
            doc, data, offsets = _texts(batch)
            for row, pos, key, ctx, left, right, p0, p1, lo, h in find_anchors(data, offsets, length, gram, hasher):
                if hot is not None and len(hot):
                    is_hot = np.isin(key.view(np.int64), hot)
                    if is_hot.any():
                        k = np.flatnonzero(is_hot)
                        n = p1[k] - p0[k]
                        p = np.repeat(p0[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        r = np.repeat(row[k], n)
                        settler.add(h.spans(0, p, p + length), h.spans(1, p, p + length), doc[r], p - np.repeat(lo[k], n), np.zeros(len(p), np.int64), np.full(len(p), length))
                        row, pos, key, ctx, left, right = (x[~is_hot] for x in (row, pos, key, ctx, left, right))
                settler.add(key, ctx, doc[row], pos, left, right)
                if settler.n >= HELD:
                    yield from emit(settler)
        yield from emit(settler)

    return run


_FOUND = "kind int, key long, doc long, start long, stop long, pos long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of whole hashes: intervals of repeated contexts (kind _COVER), and the hashes with several contexts (_BUCKET)."""
    cols = [np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in zip(*[[b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ctx", "doc", "pack")] for b in batches], strict=True)]
    if not cols:
        return
    key, ctx, doc, pack = cols
    known = pack < 0
    kd, ks, ke = doc[known], ctx[known], -1 - pack[known]
    key, ctx, doc, pack = (x[~known] for x in (key, ctx, doc, pack))
    pos, left, right = _unpack(pack)
    order, first = _first_of_equal(key, ctx, doc, pos)
    again = order[~first]
    d, s, e = _merged(np.r_[kd, doc[again]], np.r_[ks, (pos - left)[again]], np.r_[ke, (pos + right)[again]])
    keep = order[first]
    k = key[keep]
    same = np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, dtype=bool)
    keep = keep[same | np.r_[same[1:], False]] if len(k) else keep
    for kind, arrays in ((_COVER, (d, d, s, e, s)), (_BUCKET, (key[keep], doc[keep], (pos - left)[keep], (pos + right)[keep], pos[keep]))):
        for a in range(0, len(arrays[0]), 100_000):
            part = [pa.array(x[a : a + 100_000]) for x in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], ["kind", "key", "doc", "start", "stop", "pos"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each context that a bucket asks for."""
    for batch in batches:
        doc, data, offsets = _texts(batch)
        asked = batch.column("asked")
        flat, n = asked.flatten(), np.diff(asked.offsets.to_numpy())
        key, start, stop, pos = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "stop", "pos"))
        row = np.repeat(np.arange(len(n)), n)
        base = offsets[row]
        whole = data.tobytes()
        bits = [whole[a:b] for a, b in zip((base + start).tolist(), (base + stop).tolist(), strict=True)]
        for a in range(0, len(bits), 50_000):
            x = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(doc[row[x]]), pa.array(pos[x]), pa.array((pos - start)[x].astype(np.int32)), pa.array(bits[x], pa.binary())], ["key", "doc", "pos", "cut", "bits"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def maximal_repeats(occurrences: list[tuple], length: int, gram: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Repeats of at least ``length`` bytes around a shared anchor: for each common-prefix interval that is not left alike,
    its depth and (occurrence, bytes on its left that an earlier member shares) for every later member.

    occurrences: (order key, right bytes from the anchor on, left bytes reversed), ordered by their keys.
    """
    m = len(occurrences)
    sa = sorted(range(m), key=lambda i: occurrences[i][1])
    lcp = [0] + [_common(occurrences[sa[i - 1]][1], occurrences[sa[i]][1]) for i in range(1, m)] + [0]
    stack = [(0, 0)]  # (depth, left end)
    for i in range(1, m + 1):
        left = i - 1
        while stack[-1][0] > lcp[i]:
            depth, left = stack.pop()
            if depth >= gram:
                found = _left_classes(occurrences, sa[left:i], length - depth)
                if found:
                    yield depth, found
        if stack[-1][0] < lcp[i]:
            stack.append((lcp[i], left))


def _left_classes(occurrences: list[tuple], members: list[int], need: int) -> list[tuple[int, int]]:
    """For members of an interval, the longest left extension of at least ``need`` shared with any earlier member.

    In the order of left contexts the best earlier member is the nearest earlier one on either side.
    """
    ordered = sorted(members, key=lambda i: (occurrences[i][2], i))
    n = len(ordered)
    common = [_common(occurrences[ordered[j - 1]][2], occurrences[ordered[j]][2]) for j in range(1, n)]
    best = [0] * n
    have = [False] * n
    for step in (1, -1):
        stack: list[tuple[int, int]] = []  # (member, least common extension down to the next of the stack)
        for j in range(n) if step == 1 else range(n - 1, -1, -1):
            run = common[j - 1 if step == 1 else j] if stack else 0
            while stack and stack[-1][0] > ordered[j]:
                run = min(run, stack.pop()[1])
            if stack:
                best[j], have[j] = max(best[j], run), True
            stack.append((ordered[j], run))
    return [(ordered[j], best[j]) for j in range(n) if have[j] and best[j] >= max(need, 0)]


def _buckets(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            doc, pos, cut = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("doc", "pos", "cut"))
            bits = flat.field("bits").to_pylist()
            out: list[tuple[int, int, int]] = []
            base = int(ends[0])
            for a, b in zip((ends[:-1] - base).tolist(), (ends[1:] - base).tolist(), strict=True):
                ids = sorted(range(a, b), key=lambda i: (doc[i], pos[i]))
                occ = [(i, bits[i][cut[i] :], bits[i][cut[i] - 1 :: -1] if cut[i] else b"") for i in ids]
                for depth, found in maximal_repeats(occ, length, gram):
                    for o, left in found:
                        i = ids[o]
                        out.append((doc[i], pos[i] - left, pos[i] + depth))
            d, s, e = _merged(*(np.array(x, dtype=np.int64) for x in (zip(*out, strict=True) if out else ([], [], []))))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], ["doc", "start", "stop"])

    return run


#: Characters of a text by which rows are dealt to ranges; range bounds are drawn on the driver, so they hold no whole texts.
BOUND_CHARS = 128


def in_text_order(docs: DataFrame, *order: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) sorted by ``order`` (doc_id, text and what follows) over all partitions. Ranges are cut
    between ids and heads of texts, which never contradicts the order of whole texts; that is kept by the sort."""
    return docs.repartitionByRange("doc_id", F.substring("text", 1, BOUND_CHARS)).sortWithinPartitions(*order)


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text (never null): doc is unique and follows (doc_id, text). It is doc_id where that is unique."""
    twice = docs.groupBy(F.coalesce("doc_id", F.lit(_FIRST))).agg(F.count("*").alias("n")).where("n > 1")
    text = F.coalesce("text", F.lit("")).alias("text")
    if twice.isEmpty():
        return docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), "doc_id", text)
    ordered = in_text_order(docs.select("doc_id", text), "doc_id", "text")
    return written(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "ordered-docs")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, spans (start, stop): what is covered in each document of ``docs`` (doc, text); overlaps are not joined yet."""
    spark = docs.sparkSession
    texts = docs.select("doc", "text")
    seen = texts.mapInArrow(_scan(length, gram, None), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = texts.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    anchors = 2 * total // (length - gram + 2)
    most = seen.where(F.col("n") >= HOT_CONTEXTS).orderBy(F.desc("n"), "key").limit(MAX_HOT).select("key")
    hot = np.sort(most.toArrow().column("key").to_numpy().astype(np.int64))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), anchors // 2_000_000)
    met = texts.mapInArrow(_scan(length, gram, hot), _ANCHORS).repartition(parts, "key").mapInArrow(_meet, _FOUND)
    met = written(met, "anchors-met")
    asked = met.where(F.col("kind") == _BUCKET).groupBy("doc").agg(F.collect_list(F.struct("key", "start", "stop", "pos")).alias("asked"))
    contexts = texts.join(asked, "doc").select("doc", "text", "asked").mapInArrow(_cut_contexts, "key long, doc long, pos long, cut int, bits binary")
    grouped = contexts.groupBy("key").agg(F.collect_list(F.struct("doc", "pos", "cut", "bits")).alias("m"))
    extended = grouped.select("m").mapInArrow(_buckets(length, gram), "doc long, start long, stop long")
    covered = met.where(F.col("kind") == _COVER).select("doc", "start", "stop").unionByName(extended)
    return covered.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc, text, ...) with the column spans; null where nothing is covered."""
    return docs.join(repeated_spans(docs, length, gram), "doc", "left")


def join_spans(spans) -> list[tuple[int, int]]:
    """Sorted, disjoint and maximal intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def remaining(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What joined spans leave of ``data``."""
    at, kept = 0, []
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that what is left is valid text."""
    out = []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def _spans_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes | None, list[tuple[int, int]]]]:
    """Bytes and joined spans of each row of an Arrow batch (text, spans); None for a null text."""
    for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
        yield text.as_py(), join_spans((s["start"], s["stop"]) for s in spans.as_py() or ())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``docs`` (doc_id, text, spans). Ids stay Arrow columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, joined in _spans_of(batch):
                kept = remaining(data or b"", joined)
                rows.append((len(data or b""), len(data or b"") - len(kept), len(joined), hashlib.sha256(kept).hexdigest()))
            n, gone, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(run, schema)


def without_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (text, spans, ...) with the text cut to the characters that no span touches, and ``cut``: whether it has spans;
    a null text stays null. All other columns stay as they are."""
    others = [c for c in docs.columns if c not in ("text", "spans")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, joined in _spans_of(batch):
                texts.append(None if data is None else remaining(data, whole_characters(data, joined)))
            columns = [batch.column(c) for c in others]
            cut = pa.array([s.is_valid for s in batch.column("spans")], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()), cut], [*others, "text", "cut"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), "text binary, cut boolean"])
    return docs.select(*others, F.col("text").cast("binary").alias("text"), "spans").mapInArrow(run, schema).withColumn("text", F.col("text").cast("string"))
