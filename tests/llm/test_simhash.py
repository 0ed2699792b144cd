"""SimHash fingerprints and components against a plain computation over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        r = root(i)
        best[r] = min(best.get(r, d), d)
    return [best[root(i)] for i in range(len(ids))]


def near(bits, rng, flips):
    for b in rng.sample(range(64), flips):
        bits ^= 1 << b
    return bits


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_links_what_all_pairs_link(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({near(rng.choice(base), rng, rng.randint(0, 7)) for _ in range(400)})
    bits = np.array(values, dtype=np.uint64)
    label = simhash.trie_self_join(bits, np.zeros(len(bits), dtype=np.int64), 4, small=rng.choice([1, 4, 32]), step=rng.choice([7, 100000]))
    assert label.tolist() == plain_components(list(range(len(values))), values)


def test_trie_join_stays_cheap_in_a_ball():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    bits = np.array(sorted({near(centre, rng, rng.randint(0, 3)) for _ in range(20000)}), dtype=np.uint64)
    assert set(simhash.trie_self_join(bits, np.zeros(len(bits), dtype=np.int64)).tolist()) == {0}


def test_fingerprints_match_the_plain_form():
    for t in [None, "", " \t\n", "One two", "a b c d", "A b\x0bC d e f É g " * 50, "x " * 70000]:
        assert simhash.fingerprint(t) % 2**64 == plain_fingerprint(t)


def test_components_over_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "   "), (1003, "one two"), (1004, "one two"), (None, "one two")], "doc_id long, text string")
    both = docs.unionByName(extra).selectExpr("*", "1 AS fp", "2 AS component_id")
    rows = both.collect()
    got = {}
    for r in simhash.near_duplicates(both).collect():
        got[r.doc_id] = (r.fp % 2**64, r.component_id)
    ids = [r.doc_id for r in rows]
    prints = [plain_fingerprint(r.text) for r in rows]
    comps = plain_components([10**9 if i is None else i for i in ids], prints)
    assert got == {i: (p, c) for i, p, c in zip(ids, prints, comps, strict=True)}


def test_oversized_buckets_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 40)
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    values = sorted({near(centre, rng, rng.randint(0, 6)) & (2**63 - 1) for _ in range(300)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = dict(simhash.components(simhash.link_fingerprints(df)).collect())
    comp = plain_components(values, values)
    assert [roots.get(v, v) for v in values] == comp


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []


def test_chains_of_edges_reach_the_smallest(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(simhash.components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_no_similar_pair_is_lost_by_parity_maps():
    rng = np.random.default_rng(4)
    for n in (5, 40, 600, 3000):
        base = np.unique(rng.integers(-(2**31), 2**31, n).astype(np.int32))
        for share in (0.0, 0.05, 0.11, 0.5):
            other = np.unique(np.r_[base[int(share * len(base)) :], rng.integers(-(2**31), 2**31, int(share * n / 2)).astype(np.int32)])
            maps = [np.frombuffer(simhash.parity_map(x), dtype=np.uint64) for x in (base, other)]
            if simhash.jaccard(base, other) >= 0.8:
                assert simhash.may_be_similar(maps[0], maps[1], len(base), len(other), 0.8)
    far = [np.unique(rng.integers(-(2**31), 2**31, 200).astype(np.int32)) for _ in range(2)]
    assert not simhash.may_be_similar(*(np.frombuffer(simhash.parity_map(x), dtype=np.uint64) for x in far), 200, 200, 0.8)


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i % 4 if i > 20 else 9, i) for i in range(40)], "k long, v long")
    ones = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 10 AS x")
    got = simhash.join_unique(rows, ones, "k", 40).collect()
    assert len(got) == 40 and all(r.x == r.k * 10 for r in got)
