"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from millrace.llm import embedding_dedup, queries

SCHEMA = "vec_id long, embedding array<float>, label int, v int, n int, root int, cid string"


def expected(ids, vectors, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    width = max([len(v) for v, o in zip(vectors, ok, strict=True) if o], default=1)
    m = np.zeros((len(ids), width))
    for i, v in enumerate(vectors):
        if ok[i]:
            m[i, : len(v)] = np.asarray(v, dtype=np.float32)
    m /= np.where(np.array(ok), np.linalg.norm(m, axis=1), 1)[:, None]
    near = (m @ m.T >= cosine) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            least = min([root[i], *(root[j] for j in np.flatnonzero(near[i]))])
            if least < root[i]:
                root[i], changed = least, True
    out = []
    for i, r in enumerate(root):
        members = [ids[j] for j in range(len(ids)) if root[j] == r and ids[j] is not None]
        component = min(members, default=None) if ok[i] else ids[i]
        out.append((ids[i], int(near[i].sum()), component, ids[i] == component))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4, "x") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def planted(rng, n, width=24):
    """Random vectors, groups of near copies, and chains at angles close to the bound."""
    out = list(rng.standard_normal((n, width)))
    for size, noise in ((40, 0.02), (30, 0.25), (25, 0.4)):
        base = rng.standard_normal(width)
        out += [base + noise * rng.standard_normal(width) for _ in range(size)]
    return [np.float32(v).tolist() for v in out]


@pytest.mark.parametrize("seed", range(2))
def test_like_all_pairs(spark, seed):
    vectors = planted(np.random.default_rng(seed), 150)
    ids = np.random.default_rng(seed + 9).permutation(len(vectors)).tolist()
    assert rows(embedding_dedup.near_duplicate_vectors(frame(spark, ids, vectors), recall=0.9999)) == sorted(expected(ids, vectors), key=str)


def test_chunks_give_the_same(spark, monkeypatch):
    vectors = planted(np.random.default_rng(5), 60)
    ids = list(range(len(vectors)))
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", 7)
    monkeypatch.setattr(embedding_dedup, "STEP", 5)
    assert rows(embedding_dedup.near_duplicate_vectors(frame(spark, ids, vectors), recall=0.9999)) == sorted(expected(ids, vectors), key=str)


def test_edge_rows(spark):
    vectors = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [2.0, 0.0], [-1.0], [1e-30, 1e-32], [1e30, 1e28]]
    ids = [0, 1, 2, 3, None, 5, 6, None, 8, 2**60, 2**60 + 1]
    df = frame(spark, ids, vectors)
    assert rows(embedding_dedup.near_duplicate_vectors(df)) == sorted(expected(ids, vectors), key=str)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).collect() == []
    assert rows(embedding_dedup.near_duplicate_vectors(df.where("vec_id = 0"))) == [(0, 0, 0, True)]


def test_hot_vector(spark):
    """A third of all rows hold one vector, some of them under one id."""
    rng = np.random.default_rng(1)
    vectors = [[1.0, 2.0, 3.0, 4.0]] * 700 + [np.float32(v).tolist() for v in rng.standard_normal((60, 4))]
    ids = list(range(500)) + [500] * 200 + list(range(501, 561))
    assert rows(embedding_dedup.near_duplicate_vectors(frame(spark, ids, vectors), recall=0.9999)) == sorted(expected(ids, vectors), key=str)


def test_recall_near_the_bound():
    """Pairs just at the least cosine meet with the wanted chance at every size; closer ones almost always."""
    rng = np.random.default_rng(3)
    for n in (500, 50_000, 3_000_000):
        signs, tables = embedding_dedup.tables_for(n)
        for cosine, least in ((0.9, 0.95), (0.95, 0.99)):
            a = rng.standard_normal((2000, 64))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            b = rng.standard_normal((2000, 64))
            b -= (a * b).sum(1, keepdims=True) * a
            b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
            planes = rng.standard_normal((64, signs * tables))
            same = ((a @ planes >= 0) == (b @ planes >= 0)).reshape(2000, tables, signs).all(2).any(1)
            assert same.mean() >= least


def test_query(spark, small):
    found = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    assert rows(queries.op12_embedding_dedup(spark, small)) == sorted(expected([r.vec_id for r in found], [r.embedding for r in found]), key=str)
