r"""Document fingerprints as threshold-scaled sketches.

A sketch keeps the hash of every word shingle that is below 2**64 / scale, so its size follows the document's and two
sketches of one scale can be merged by union and compared for likeness (Jaccard) or containment whatever the documents'
sizes. A document of which no hash is below the threshold keeps its least hash instead, marked with ``~``.

Texts are lower-cased in A-Z and split into words at ASCII white space; a shingle is five words, the whole sequence where
there are fewer. The printed form is the sorted kept hashes, 8 hex digits each (the 32 leading bits under the threshold).

Defined results: null, empty and blank texts have the empty sketch; two empty sketches are alike (1), an empty and another
are not (0); repeated rows are documents of their own, those of one doc_id in the order of their texts; a null doc_id comes
before all others; a table of one document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 4
WORDS = 5
#: Bytes of text whose shingles are hashed at a time, and bytes of text in a partition of neighbouring documents.
_CHUNK = 1 << 20
RANGE_BYTES = 32 << 20
#: Ranges of neighbouring ids at most, and ids drawn for each to find its bounds.
MAX_RANGES, SAMPLE = 65_536, 16
_FIRST = -(2**63)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xA24BAED4963EE407)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Sketches of many texts at a time, with array operations over their joined bytes."""

    def __init__(self, scale: int = SCALE, words: int = WORDS):
        self.scale, self.words, self.size = scale, words, 0

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * _CHUNK)
            up, down = np.full(self.size, _BASE, dtype=np.uint64), np.full(self.size, pow(_BASE, -1, 2**64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every shingle, in order."""
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = _SPACE[buf]
        edges = np.diff(np.r_[True, space].astype(np.int8))  # -1: a word starts, 1: it has ended
        start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        c = buf.astype(np.uint64) + np.uint64(1)
        upper = (buf >= 65) & (buf <= 90)
        c[upper] += np.uint64(32)
        up, down = self._powers(len(c) + 1)
        sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(c * up[:-1])]
        word = _mix((sums[end] - sums[start]) * down[start])
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, start, side="right")
        n = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(n) - n
        long = np.flatnonzero(n >= self.words)
        m = n[long] - self.words + 1
        at = np.repeat(first[long] - np.cumsum(m) + m, m) + np.arange(m.sum())
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(self.words):
            h = h * _STEP + word[at + j]
        short = np.flatnonzero((n > 0) & (n < self.words))
        g = np.zeros(len(short), dtype=np.uint64)
        for j in range(self.words - 1):
            more = n[short] > j
            g[more] = g[more] * _STEP + word[first[short][more] + j]
        return np.r_[np.repeat(long, m), short], _mix(np.r_[h, g])

    def sketches(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted kept hashes of each text; a lone hash over the threshold is a text's least."""
        if sum(map(len, texts)) > _CHUNK and len(texts) > 1:
            half = len(texts) // 2
            return self.sketches(texts[:half]) + self.sketches(texts[half:])
        doc, h = self.shingles(texts)
        least = np.full(len(texts), 2**64 - 1, dtype=np.uint64)
        np.minimum.at(least, doc, h)
        below = h <= np.uint64(2**64 // self.scale - 1)
        has = np.zeros(len(texts), dtype=bool)
        has[doc] = True
        kept = np.zeros(len(texts), dtype=bool)
        kept[doc[below]] = True
        lone = np.flatnonzero(has & ~kept)
        doc, h = np.r_[doc[below], lone], np.r_[h[below], least[lone]]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, dtype=bool)
        doc, h = doc[new], h[new]
        return np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))

    def printed(self, sketch: np.ndarray) -> str:
        if len(sketch) == 1 and sketch[0] >= 2**64 // self.scale:
            return f"~{int(sketch[0]):016x}"
        return ((sketch * np.uint64(self.scale)) >> np.uint64(32)).astype(">u4").tobytes().hex()


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two documents' shingles."""
    both = _shared(a, b)
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return _shared(a, b) / len(a) if len(a) else 1.0


def merged(sketches: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The sketch of all documents together: a least hash is kept only if nothing is below the threshold."""
    union = np.unique(np.concatenate(sketches)) if sketches else np.zeros(0, dtype=np.uint64)
    below = union[union <= np.uint64(2**64 // scale - 1)]
    return below if len(below) else union[:1]


def half_edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(rows: DataFrame, total: int, n: int) -> np.ndarray:
    """At most n - 1 ids that divide the rows into about equal ranges, from ids drawn by their hash: SAMPLE a range are expected."""
    part = min(1.0, n * SAMPLE / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("d", F.lit(17)), F.lit(1 << 40)) < F.lit(int(part * (1 << 40)))).select("d")
    ids = np.sort(drawn.toArrow().column("d").to_numpy().astype(np.int64))
    return np.unique(ids[[len(ids) * i // n for i in range(1, n)]]) if len(ids) else ids


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row, sorted by (doc_id, text) in partitions of neighbouring ids; each partition ends with a
    copy (guest) of the first row of the next one, the last partition with a copy of the very first row.

    Partitions are read as streams, so their size isn't bounded by memory; there are MAX_RANGES at most, which bounds what the
    driver draws (SAMPLE ids a range) and what tasks hold of it (an id a range, and the first id of each range).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("d"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    n = max(1, min(int(size.n), MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.b or 0) // RANGE_BYTES)))
    cuts = _cuts(rows, size.n, n)
    firsts = _with_range(rows.select("d"), cuts).groupBy("own").agg(F.min("d").alias("head")).orderBy("own").toArrow()
    own, head = (firsts.column(c).to_numpy().astype(np.int64) for c in ("own", "head"))
    before = np.roll(own, 1)  # the range before each one; that of the first is the last

    @F.pandas_udf("array<struct<part:int,guest:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        d = ids.to_numpy()
        where = np.searchsorted(cuts, d, side="right")
        at = np.searchsorted(own, where)
        return pd.Series([[(o, False), (int(before[k]), True)] if h == i else [(o, False)] for i, o, k, h in zip(d.tolist(), where.tolist(), at.tolist(), head[at].tolist(), strict=True)])

    dealt = rows.withColumn("at", F.explode(places("d"))).select("at.part", "at.guest", "d", "doc_id", "text")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "d", "text")


def _with_range(ids: DataFrame, cuts: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def own(d: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, d.to_numpy(), side="right").astype(np.int32))

    return ids.withColumn("own", own("d"))


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edited(docs: DataFrame, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """COLUMNS of every row: its sketch beside that of its half-edited text and of the next document by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(scale, words)
        held: list[tuple] = []

        def compared(pairs: list[tuple]) -> pa.RecordBatch:
            """pairs: rows of which all but the last are answered."""
            texts = [t for _, t in pairs]
            edited = [half_edited(a, b).encode("utf-8", "surrogatepass") for a, b in zip(texts, texts[1:], strict=False)]
            own = sketcher.sketches([t.encode("utf-8", "surrogatepass") for t in texts])
            new = sketcher.sketches(edited)
            cols = (
                [d for d, _ in pairs[:-1]],
                [len(t) for t in texts[:-1]],
                [hashlib.sha256(t).hexdigest() for t in edited],
                [sketcher.printed(s) for s in own[:-1]],
                [sketcher.printed(s) for s in new],
                [likeness(a, b) for a, b in zip(own, new, strict=False)],
                [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
            )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

        size, over = 0, False
        for batch in batches:
            for guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
                if over:
                    continue
                held.append((doc_id, text))
                size += len(text)
                over = guest  # the first guest is all that the last own row needs
                if (size > _CHUNK or over) and len(held) > 1:
                    yield compared(held)
                    held, size = held[-1:], 0

    return beside_next(docs).select("guest", "doc_id", "text").mapInArrow(run, COLUMNS)
