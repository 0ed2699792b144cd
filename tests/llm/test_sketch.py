"""Scaled sketches against plain sets of shingles."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import sketch


def shingle_set(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def words(rng, n):
    return " ".join(rng.choice(["Ab", "é", "foo", "bar", "x" * 9, "qux\n"]) + str(rng.randrange(50)) for _ in range(n))


def test_full_scale_sketch_counts_every_shingle():
    rng = random.Random(0)
    texts = [words(rng, n) for n in (0, 1, 3, 4, 5, 6, 300)] + ["", " \t "]
    s = sketch.Sketcher(scale=1)
    got = s.sketches([t.encode() for t in texts])
    assert [len(g) for g in got] == [len(shingle_set(t)) for t in texts]
    assert [g.tolist() for g in got] == [s.sketches([t.encode()])[0].tolist() for t in texts]


def test_likeness_follows_jaccard():
    rng = random.Random(1)
    a = words(rng, 4000).split()
    for share in (0.2, 0.5, 0.9):
        b = a[: int(len(a) * share)] + words(rng, 1500).split()
        x, y = " ".join(a), " ".join(b)
        p, q = sketch.Sketcher().sketches([x.encode(), y.encode()])
        s, t = shingle_set(x), shingle_set(y)
        assert abs(sketch.likeness(p, q) - len(s & t) / len(s | t)) < 0.05
        assert abs(sketch.containment(p, q) - len(s & t) / len(s)) < 0.05


def test_merging_and_lone_hashes():
    s = sketch.Sketcher(scale=1 << 40)
    a, b = s.sketches([b"one two", b"three four"])
    assert len(a) == len(b) == 1 and s.printed(a)[0] == "~"
    assert sketch.merged([a, b], 1 << 40).tolist() == [min(a[0], b[0])]
    assert sketch.likeness(np.zeros(0), np.zeros(0)) == 1.0 and sketch.likeness(a, np.zeros(0, dtype=np.uint64)) == 0.0


@pytest.mark.parametrize("n", [1, 2, 40])
def test_every_row_meets_the_next(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 + 1, words(rng, rng.choice([0, 2, 30, 400]))) for i in range(n)]
    rows[0] = (rows[0][0], None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "'x' AS guest")
    got = {r.doc_id: r for r in sketch.compare_with_edited(df).collect()}
    assert len(got) == n
    s = sketch.Sketcher()
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        a, b = texts[k], texts[(k + 1) % n]
        e = sketch.half_edited(a, b)
        p, q, r = s.sketches([a.encode(), e.encode(), b.encode()])
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (s.printed(p), s.printed(q))
        assert (got[i].near_edited, got[i].near_next) == (sketch.likeness(p, q), sketch.likeness(p, r))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, "d")], "doc_id long, text string")
    assert sketch.compare_with_edited(df).count() == 4
    assert sketch.compare_with_edited(df.limit(0)).count() == 0
