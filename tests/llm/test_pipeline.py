"""Every stage of the pipeline against plain computations on its own input."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from millrace.llm import simhash

from .test_packing import check_rules
from .test_suffix_dedup import plain


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    s, t = shingles(a), shingles(b)
    return len(s & t) >= 0.8 * len(s | t)


def edited(text, rng, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_go(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 400))), f"s{i % 3}") for i in range(60)]
    for k in range(60):
        base = rng.choice(rows)[1]
        rows.append((100 + k, base if k % 4 == 0 else edited(base, rng, rng.choice([1, 2, 4, 8, 30])), "s0"))
    rows += [(300, None, "a"), (301, "", "b"), (302, " ", "b"), (60, rows[0][1], "dup")]
    docs = table(spark, rows)
    got = sorted((r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").select("doc_id", "text").collect() if r.text)
    ordered = sorted(((i, t) for i, t, _ in rows if t and t.strip()))
    parent = list(range(len(ordered)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ordered)):
        for j in range(i):
            if similar(ordered[i][1], ordered[j][1]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = [x for i, x in enumerate(ordered) if root(i) == i]
    assert [x for x in got if x[1].strip()] == want


def test_cut_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEETING_ROWS", 10)
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, edited(base, rng, 3)) for i in range(60)], "doc long, text string")
    assert {r.keep for r in simhash.similar_documents(docs).collect()} == {0}


def signed(text):
    return simhash.signature(simhash.hashes(simhash.words_of(text), 5))


def test_pairs_that_share_no_least_hash_or_differ_in_many_bits_are_linked(spark):
    # short texts at a similarity of exactly 0.8 (9 against 8 words) and long ones whose least hashes all differ
    rng = random.Random(5)
    found, n = [], 0
    while len(found) < 4:
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        a, b = signed(" ".join(words)), signed(" ".join(words[:-1]))
        n += 1
        if ((a[0] ^ b[0]) % 2**64).bit_count() > 20:
            found.append((" ".join(words), " ".join(words[:-1])))
    while len(found) < 6:
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        least = set(signed(" ".join(words))[1])
        other = edited(" ".join(words), rng, 6)
        if not least & set(signed(other)[1]) and similar(" ".join(words), other):
            found.append((" ".join(words), other))
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(found) for k, t in enumerate(p)], "doc long, text string")
    got = {r.doc: r.keep for r in simhash.similar_documents(docs).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


def test_case_and_white_space_make_no_other_text(spark, monkeypatch):
    def none(*_):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows, "equal words must not be compared"
                yield from ()

        return run

    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text.title() if i % 2 else text.replace(" ", " " * (1 + i))) for i in range(20)], "doc long, text string")
    monkeypatch.setattr(simhash, "_verified", none)
    assert {r.keep for r in simhash.similar_documents(docs).collect()} == {0}


def test_equal_fingerprints_take_no_square_of_pairs():
    n, asked, most = 20000, 0, 0

    def check(label, i, j):
        nonlocal asked, most
        asked, most = asked + len(i), max(most, len(i))
        simhash._settle(label, i, j)

    label = simhash.trie_self_join(np.full(n, 7, dtype=np.uint64), np.zeros(n, dtype=np.int64), 20, settle=check)
    assert set(label.tolist()) == {0} and most < n and asked < 2 * n


def test_buckets_cut_by_bytes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEETING_BYTES", 8000)
    rng = random.Random(9)
    base = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, edited(base, rng, 3)) for i in range(60)], "doc long, text string")
    assert {r.keep for r in simhash.similar_documents(docs).collect()} == {0}


def test_repeats_are_cut(spark, small):
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame(rows, rows[0].__fields__ and spark.read.parquet(f"{small}/documents.parquet").schema)
    got = {r.doc_id: r for r in cp.cut_repeats(spark, docs, "").collect()}
    spans = plain([r.text.encode() for r in rows], 100)
    for r, cut in zip(rows, spans, strict=True):
        data = r.text.encode()
        kept = b"".join(data[e:s] for e, s in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)], strict=True))
        if not kept:
            assert r.doc_id not in got
        elif not cut:
            assert got[r.doc_id] == r
        else:
            assert got[r.doc_id].text.encode().replace(b"", b"") and abs(len(got[r.doc_id].text.encode()) - len(kept)) <= 6 * len(cut)
            assert got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_toxic_documents_go(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    kept = cp.drop_toxic(spark, docs, base)
    assert kept.columns == cp.DOCUMENTS
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in ids for i in clean) >= 0.95 * len(clean)
    assert sum(i not in ids for i, y in labels.items() if y == 1) >= 0.6 * sum(labels.values())


def test_whole_pipeline(spark, small):
    assert __spark_entry__.queries()["pipeline"] is cp.run
    rows = cp.run(spark, small).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= docs and len({r.doc_id for r in rows}) > 0.5 * len(docs)
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.units
    check_rules(rows, sizes, 8192)


def test_empty_table(spark, small):
    docs = table(spark, []).withColumn("part", F.lit(1))
    for _, stage in cp.STAGES:
        assert stage(spark, docs, small).collect() == []
