"""Removal of repeated strings against a plain set of all strings seen."""

import random

import pytest

from millrace.llm import suffix_dedup


def plain(docs, length):
    """Covered spans by document: every string of ``length`` bytes, looked up among all that start earlier."""
    seen, out = set(), []
    for data in docs:
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(s)
        spans, p = [], 0
        while p < len(data):
            if covered[p]:
                q = p
                while q < len(data) and covered[q]:
                    q += 1
                spans.append((p, q))
                p = q
            else:
                p += 1
        out.append(spans)
    return out


def found(spark, texts, ids=None, **kw):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    docs = suffix_dedup.keyed_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = suffix_dedup.with_spans(docs, **kw).collect()
    return {r.doc_id: suffix_dedup.join_spans((s.start, s.stop) for s in r.spans or []) for r in got}


def corpus(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(5, 60)) for _ in range(6)]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if docs and kind < 0.2:
            docs.append(rng.choice(docs))
        elif docs and kind < 0.45:
            w = rng.choice(docs).split(" ")
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append(" ".join(w))
        elif kind < 0.8:
            docs.append(" ".join(rng.choice([text(rng.randint(0, 30)), rng.choice(shared)]) for _ in range(rng.randint(1, 7))))
        else:
            docs.append(rng.choice(["", "a" * rng.randint(0, 400), "ab " * rng.randint(0, 150), text(200)]))
    return docs


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [False, True])
def test_against_all_strings(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 3)
        monkeypatch.setattr(suffix_dedup, "HELD_HOT", 2)
    if seed % 2:
        monkeypatch.setattr(suffix_dedup, "HELD", 50)
        monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    docs = corpus(random.Random(seed), 60)
    want = plain([d.encode() for d in docs], 100)
    assert found(spark, docs) == dict(enumerate(want))


def test_shorter_strings(spark):
    docs = corpus(random.Random(9), 40)
    assert found(spark, docs, length=20, gram=8) == dict(enumerate(plain([d.encode() for d in docs], 20)))


def test_sample_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(80).collect()
    want = plain([r.text.encode() for r in rows], 100)
    assert found(spark, [r.text for r in rows], [r.doc_id for r in rows]) == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_nulls_repeated_ids_and_empty_tables(spark):
    a, b = "x".join(map(str, range(80))), "y".join(map(str, range(80)))
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, [tuple(s) for s in r.spans or []] != []) for r in suffix_dedup.with_spans(suffix_dedup.keyed_documents(docs)).collect())
    assert got == sorted([(1, a, False), (1, a, True), (1, b, True), (0, b, False), (2, "", False), (3, "", False)])
    assert suffix_dedup.with_spans(suffix_dedup.keyed_documents(docs.limit(0))).collect() == []


def test_characters_stay_whole():
    data = "aéb".encode()
    assert suffix_dedup.whole_characters(data, [(0, 2)]) == [(0, 1)]
    assert suffix_dedup.whole_characters(data, [(2, 4)]) == [(3, 4)]
    assert suffix_dedup.whole_characters(data, [(1, 2)]) == []


def test_large_ids_beside_null(spark):
    text = " ".join(map(str, range(60)))
    ids = [2**60 + 1, 2**60 + 3, None]
    docs = suffix_dedup.keyed_documents(spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").coalesce(1))
    rows = suffix_dedup.with_spans(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.digests(rows).collect()} == {None: (len(text), 0), 2**60 + 1: (len(text), len(text)), 2**60 + 3: (len(text), len(text))}
    left = {r.doc_id: (r.text, r.cut) for r in suffix_dedup.without_spans(rows).collect()}
    assert left == {None: (text, False), 2**60 + 1: ("", True), 2**60 + 3: ("", True)}


def test_rows_of_one_id_are_in_the_order_of_whole_texts(spark):
    rng = random.Random(3)
    head = "é" * (suffix_dedup.BOUND_CHARS - 1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), head[: rng.choice([5, 127])] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    docs = suffix_dedup.keyed_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = [(r.doc_id, r.text) for r in docs.orderBy("doc").collect()]
    assert got == sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1].encode()))
