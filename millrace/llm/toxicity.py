"""Toxicity by compression distance between two zstandard dictionaries.

Two dictionaries are trained on labelled text, one on toxic and one on ordinary documents, and every window of a text is
compressed with both; a window that comes out shorter by some bytes with the toxic one speaks for toxicity.

A window is a word without punctuation between two fixed ends that both dictionaries hold: whatever the word, the block is
worth compressing and the word lies where matches are looked for, so the two lengths differ by what the dictionaries know of
it. Most of toxic documents' text is ordinary too, so training runs in rounds: windows of toxic documents that the toxic
dictionary shortens, and that far fewer ordinary documents hold, train the next toxic dictionary; windows of ordinary
documents that it shortens wrongly train the next ordinary one. Both share a part trained on ordinary text and have equal
sizes, so that match distances cost alike. Counts of windows by length difference, calibrated on labelled documents that no
dictionary has seen, give the document's score by logistic regression.

Defined results: null, empty and wordless texts are scored as texts without windows; labels of documents that aren't there
don't count, and of several labels the highest does; without documents of both labels all scores are 0; repeated rows are
scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.workers import given_back

#: Labelled documents for training: at most this many of each label, and this many bytes of their text.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 10 << 20
#: Bytes of the part that both dictionaries share, and of the part of their own.
SHARED, OWN = 110_000, 8192
LEVEL = 12
ROUNDS = 4
#: Length differences whose windows are counted.
MARGINS = (2, 3, 4, 5)
#: A toxic window must be in this many toxic documents, and in this many times the ordinary documents' share.
LEAST_DOCS, LEAST_RATIO = 3, 4.0
REMEMBERED = 400_000
_END = bytes(range(128, 192))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def windows(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WindowDistance(dict):
    """Bytes by which the toxic dictionary shortens a window more than the ordinary one; a bounded number is remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.compress = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def __missing__(self, word: bytes) -> int:
        window = b"%b %b %b" % (_END, word, _END[::-1][:32])
        ordinary, toxic = self.compress
        found = len(ordinary(window)) - len(toxic(window))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def _trained(docs: list[list[bytes]], size: int) -> bytes:
    """A dictionary that zstandard trains on runs of three windows."""
    samples = [b" ".join(ws[i : i + 3]) for ws in docs for i in range(0, len(ws), 3)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the text itself
        return b" ".join(samples)[-size:]


def _content(words: list[bytes], size: int) -> bytes:
    """Windows as dictionary content, the last one nearest to what is compressed."""
    return (b" " + b" ".join(words) + b" ")[-size:].rjust(size, b"\0")


def _docs_with(docs: list[list[bytes]]) -> Counter:
    out: Counter = Counter()
    for ws in docs:
        out.update(set(ws))
    return out


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @property
    def name(self) -> str:
        return hashlib.sha256(repr((self.toxic, self.ordinary, self.weights)).encode()).hexdigest()

    def score(self, features: list[float]) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(self.weights[1:], features, self.mean, self.scale, strict=True))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _features(distance: WindowDistance, words: list[bytes]) -> list[float]:
    n = max(1, len(words))
    counts = [0] * (MARGINS[-1] + 1)
    for d in map(distance.__getitem__, words):
        if d >= MARGINS[0]:
            counts[min(d, MARGINS[-1])] += 1
    k = [sum(counts[m:]) for m in MARGINS]
    return [math.log1p(x) for x in k] + [math.log1p(1000 * x / n) for x in k] + [math.log1p(n)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps for a ridge-penalised logistic regression on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    b = np.zeros(z.shape[1])
    penalty = ridge * np.r_[1e-6, np.ones(len(b) - 1)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * b)
    return mean, scale, b


def fit(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> ToxicityModel:
    """A model from the windows of labelled documents; every third document calibrates, the others train dictionaries."""
    if not toxic or not ordinary:
        return ToxicityModel()
    part = lambda docs, held: [d for i, d in enumerate(docs) if (i % 3 == 0) == held] or docs
    tox, plain = part(toxic, False), part(ordinary, False)
    in_tox, in_plain = _docs_with(tox), _docs_with(plain)
    shared = _trained(plain, SHARED)[-SHARED:] + _END + _END[::-1]
    first = 4 * OWN
    own_tox, own_plain = (_trained(d, first)[-first:].rjust(first, b"\0") for d in (tox, plain))
    least = LEAST_DOCS if len(tox) >= 20 * LEAST_DOCS else 1
    for _ in range(ROUNDS):
        distance = WindowDistance(shared + own_tox, shared + own_plain)
        share = {w: n / len(tox) for w, n in in_tox.items() if n >= least and distance[w] >= MARGINS[0]}
        keep = sorted((w for w in share if share[w] > LEAST_RATIO * (in_plain[w] + 0.5) / len(plain)), key=lambda w: (in_tox[w], w))
        if not keep:
            break
        kept = set(keep)
        wrong = sorted((w for w in in_plain if w not in kept and distance[w] >= MARGINS[0]), key=lambda w: (in_plain[w], w))
        own_tox, own_plain = _content(keep, OWN), _content(wrong, OWN)
    model = ToxicityModel(shared + own_tox, shared + own_plain)
    distance = WindowDistance(model.toxic, model.ordinary)
    held = [(d, 1) for d in part(toxic, True)] + [(d, 0) for d in part(ordinary, True)]
    mean, scale, b = _logistic(np.array([_features(distance, d) for d, _ in held]), np.array([y for _, y in held]))
    # The sample holds both labels in other shares than the corpus; the intercept is put right by the caller.
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), b.tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, may_learn=None) -> ToxicityModel:
    """A model from a bounded sample of the labelled ``docs``: labels (doc_id, toxic) under the condition ``may_learn``."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    shares = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    ids = [(r.doc_id, r.toxic) for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(SAMPLE_DOCS).collect()]
    if len({y for _, y in ids}) < 2:
        return ToxicityModel()
    sample = docs.join(F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int")), "doc_id")  # 2 * SAMPLE_DOCS rows
    sizes = {r.doc_id: r.b for r in sample.groupBy("doc_id").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("b")).collect()}
    picked, used = [], {0: 0, 1: 0}
    for i, y in ids:
        if used[y] + sizes[i] <= SAMPLE_BYTES:  # whole documents only
            used[y] += sizes[i]
            picked.append((i, y))
    chosen = sample.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = {r.doc_id: windows(r.text) for r in chosen.toLocalIterator()}
    model = fit(*[[texts[i] for i, y in picked if y == label] for label in (1, 0)])
    if model.weights:
        n = {y: sum(1 for _, x in picked if x == y) for y in (0, 1)}
        model.weights[0] += math.log(shares[1] / shares[0]) - math.log(n[1] / n[0])
    return model


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with the column score of every whole text."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # What is remembered of windows is a task's own, and goes with it.
        distance = WindowDistance(model.toxic, model.ordinary) if model.weights else None
        for batch in texts:
            if distance is None:
                yield pd.Series(np.zeros(len(batch)))
                continue
            yield pd.Series([model.score(_features(distance, windows(t))) for t in batch], dtype="float64")
        del distance
        given_back()

    return docs.withColumn("score", score("text"))
