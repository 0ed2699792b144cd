"""Sharding, chat formatting and exact top-k against plain loops, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import chat_format, queries, sharding, topk

# ---- sharding


def check_shards(rows, texts, n_shards):
    """Every record once, sizes and CRCs right, gapless slots, shards near equal in bytes."""
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    assert all(0 <= s < n_shards for s in by_shard)
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return {s: sum(r.size for r in m) for s, m in by_shard.items()}


@pytest.mark.parametrize("seed", range(3))
def test_shards_have_equal_bytes(spark, seed):
    rng = random.Random(seed)
    texts = ["hot text"] * 400 + ["w" * rng.randrange(60) + str(i % 90) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = sharding.shard_by_bytes(docs, 7, rows_per_range=100).collect()
    sizes = check_shards(rows, texts, 7)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 2 * max(len(t.encode()) + 16 for t in texts) + 0.02 * sum(sizes.values()) / 7
    again = sharding.shard_by_bytes(docs.repartition(5), 7, rows_per_range=100).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_shard_edge_rows(spark):
    texts = [None, "", "é" * 50_000, "same", "same", "same", "x"]
    ids = [5, None, 2**60 + 1, 7, 7, None, 2**60 + 3]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, size int, shard int, k int, range_id int")
    rows = sharding.shard_by_bytes(docs, 3).collect()
    check_shards(rows, texts, 3)
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
    assert sharding.shard_by_bytes(docs.limit(0), 3).collect() == []


def test_equal_rows_are_divided(spark):
    """Rows that are equal in all are no single range, and still make shards of equal bytes."""
    docs = spark.createDataFrame([(5, "one row of all")] * 3000 + [(i, f"text {i}") for i in range(6000)], "doc_id long, text string").repartition(4)
    rows = sharding.shard_by_bytes(docs, 6, rows_per_range=200).collect()
    sizes = check_shards(rows, [r.text for r in docs.collect()], 6)
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 6 + 60
    ranges = defaultdict(int)
    for r in rows:
        ranges[r.range_id] += 1
    assert max(ranges.values()) < 1200


def test_sharding_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = queries.op1_sharding(spark, small).collect()
    check_shards(rows, [d.text for d in docs], 40)
    assert {r.law for r in rows} == {"bytes"} and {r.doc_id for r in rows} == {d.doc_id for d in docs}


# ---- chat formatting


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations_are_read_back(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "<\\|", "<|", "\\<|im_sep|>\\\\", "", "é😀\r\n\n", "<\\/", "x" * 1_500_000]
    rows, want = [], {}
    for c in range(6):
        turns = [(random.Random(c * 50 + i).choice(["user", "assistant", "system", "a\n<|b\\"]), hard[(c + i) % len(hard)]) for i in range(7)]
        want[c] = turns
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    for c, turns in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].masked == [t for r, t in turns if r == "assistant"] and back[c].mask_fits


def test_conversation_edge_rows(spark):
    rows = [(1, 1, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 1, "user", "q"), (2**60 + 1, None, None, "n"), (2**60 + 3, 2, "assistant", "z")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_mask int")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert got == {1: [("assistant", "b"), ("assistant", "b"), ("user", "")], None: [("user", "q")], 2**60 + 1: [("", "n")], 2**60 + 3: [("assistant", "z")]}
    assert chat_format.format_conversations(turns.limit(0)).collect() == []


def test_same_roles_share_a_block(spark):
    turns = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(["user", "user", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    text = chat_format.format_conversations(turns).first().formatted
    assert text == "<|im_start|>user\nt0<|im_sep|>t1<|im_end|>\n<|im_start|>assistant\nt2<|im_end|>\n<|im_start|>user\nt3<|im_end|>\n"


# ---- exact top-k


def plain_top_k(queries, rows, k):
    out = []
    for q, v in queries:
        scores = [(-min(max(sum(int(x) * int(y) for x, y in zip(v, w, strict=False)), -(2**63)), 2**63 - 1), i) for i, w in rows if i != q]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def top(spark, queries, rows, k):
    schema = "id long, v array<double>"
    found = topk.exact_top_k(spark.createDataFrame(queries, schema), spark.createDataFrame(rows, schema), k).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_with_ties(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "ENOUGH", 4)
    monkeypatch.setattr(topk, "PART_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "ROW_STEP", 17)
    monkeypatch.setattr(topk, "QUERY_STEP", 3)
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(rng.choice([3, 3, 2, 0]))]) for i in range(150)] + [(200 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    queries = [r for r in rows if r[0] % 20 == 0]
    assert top(spark, queries, rows, 5) == plain_top_k(queries, rows, 5)


def test_top_k_beyond_doubles_and_64_bits(spark, monkeypatch):
    monkeypatch.setattr(topk, "ENOUGH", 2)
    rows = [(1, [2.0**31, 3.0]), (2, [2.0**31, 5.0]), (3, [1e300, 1.0]), (4, [-1e300, 1.0]), (5, [0.0, 7.0]), (6, [-(2.0**30), 1.0]), (7, [1e300, -1e300])]
    assert top(spark, rows, rows, 3) == plain_top_k(rows, rows, 3)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, 1.0], 9), (2, None, 9), (3, [nan, 1.0], 9), (4, [inf, 1.0], 9), (5, [None, 1.0], 9), (None, [1.0, 1.0], 9), (6, [-0.001, 1e38], 9), (2**60 + 1, [0.25, -0.5], 9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int")
    rows = topk.integer_vectors(df.drop("id"), "vec_id", "embedding")
    got = {r.id: r.v for r in rows.collect()}
    assert got == {1: [128.0, 256.0], 6: [-1.0, float(np.float32(1e38)) * 256], 2**60 + 1: [64.0, -128.0]}
    best = topk.exact_top_k(rows, rows, 2)
    assert sorted((r.query_id, r.vec_id) for r in best.where("rank = 1").collect()) == [(1, 6), (6, 1), (2**60 + 1, 1)]
    assert topk.exact_top_k(rows.limit(0), rows.limit(0), 2).collect() == [] and topk.exact_top_k(rows, rows.limit(0), 2).collect() == []


def test_repeated_rows(spark):
    rows = [(1, [1.0]), (1, [1.0]), (2, [1.0]), (2, [2.0]), (3, [1.0])]
    assert top(spark, [(1, [1.0]), (1, [1.0])], rows, 5) == sorted([(1, 1, 2, 2), (1, 2, 2, 1), (1, 3, 3, 1)] * 2)


def test_one_id_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_BYTES", 8 * 3 * 50)
    rng = random.Random(8)
    rows = [(50, [float(rng.randrange(9)) for _ in range(3)]) for _ in range(150)] + [(i, [float(rng.randrange(9)) for _ in range(3)]) for i in range(51, 350)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = topk.exact_top_k(df.where("id % 100 = 0"), df, 4).collect()
    want = []
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-int(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
