"""Packing against a plain best-fit, and the rules that every bin must keep."""

import random
from collections import Counter
from collections import defaultdict

import pytest

from millrace.llm import packing


def plain_best_fit(items, capacity):
    bins, out = [], []
    for units, source, cluster in items:
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= units and source not in b["sources"] and (not cluster or cluster not in b["clusters"])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
        bins[i]["room"] -= units
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    items = sorted(((rng.choice([0, 1, 5, rng.randint(0, 100)]), rng.randrange(6), rng.choice([0, 0, rng.randrange(9)])) for _ in range(300)), reverse=True)
    assert packing.best_fit(items, 100) == plain_best_fit(items, 100)


def check_rules(rows, sizes, capacity):
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.pack, r.bin].append(r)
        parts[r.doc_id].append(r)
    for members in bins.values():
        assert sum(r.units for r in members) <= capacity
        assert len({r.source for r in members}) == len(members) and len({r.cluster for r in members}) == len(members)
        assert sorted(r.place for r in members) == list(range(len(members)))
    for i, size in sizes.items():
        assert sum(r.units for r in parts[i]) == size and sorted(r.part for r in parts[i]) == list(range(len(parts[i])))


def test_documents(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "PACK_ROWS", 60)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    packed = packing.pack_documents(docs, 4096)
    rows = packed.collect()
    sizes = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    assert len({r.pack for r in rows}) > 2 and {r.doc_id for r in rows} == set(sizes)
    check_rules(rows, sizes, 4096)
    seq = packing.sequences(packed).collect()
    assert sum(s.used for s in seq) == sum(sizes.values()) and sum(len(s.docs) for s in seq) == len(rows)


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x" * 250, "a"), (4, "x" * 200, "a"), (5, "A  b", "b"), (6, "a B", "c"), (6, "a B", "c"), (None, "q", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS bin", "2 AS units")
    got = packing.pack_documents(docs, 100).collect()
    assert sorted((r.doc_id or 0, r.part, r.units) for r in got) == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 100), (3, 1, 100), (3, 2, 50), (4, 0, 100), (4, 1, 100), (5, 0, 4), (6, 0, 3), (6, 0, 3), (0, 0, 1)])
    same = [(r.pack, r.bin) for r in got if r.doc_id in (5, 6)]
    assert len(same) == len(set(same))
    assert packing.pack_documents(docs.limit(0), 100).collect() == []


def test_large_ids_beside_null(spark):
    ids = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    docs = spark.createDataFrame([(i, "x" * 150, "s") for i in ids], "doc_id long, text string, source string").coalesce(1)
    got = packing.pack_documents(docs, 100).collect()
    assert sorted((str(r.doc_id), r.part) for r in got) == sorted((str(i), k) for i in ids for k in (0, 1))


def test_one_hot_source_is_packed_fast():
    items = [(7, 0, 0)] * 6000 + [(5, 1, 0)] * 6000
    bins = packing.best_fit(items, 12)
    assert len(set(bins)) == 6000 and bins[:6000] == list(range(6000)) and sorted(bins[6000:]) == list(range(6000))


def test_packs_follow_from_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = sorted(map(str, packing.pack_documents(docs).collect()))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, packing.pack_documents(docs).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_equal_rows_are_spread_over_packs(spark, monkeypatch):
    """A third of all rows are one row: they don't make one pack."""
    monkeypatch.setattr(packing, "PACK_ROWS", 400)
    rows = [(7, "one row " * 3, "s")] * 1200 + [(i, f"text {i} " * (i % 9 + 1), f"s{i % 5}") for i in range(100, 2500)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), packing.CAPACITY).collect()
    assert len(packed) == len(rows)
    sizes = Counter(r.pack for r in packed)
    assert len(sizes) == 9 and max(sizes.values()) < 2 * len(rows) / 9
