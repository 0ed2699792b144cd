"""The Merkle manifest against a plain tree, and proofs that hold only for what they were made for."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, idx string, h int, t int, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(hashes):
    """The root and, for each leaf, its steps (siblings left, siblings right)."""
    paths, groups = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, members = [], []
        for at in range(0, len(hashes), 16):
            run = hashes[at : at + 16]
            for k in range(len(run)):
                for i in groups[at + k]:
                    if len(run) > 1:
                        paths[i].append((run[:k], run[k + 1 :]))
            above.append(sha("".join(run)))
            members.append([i for g in groups[at : at + 16] for i in g])
        hashes, groups = above, members
    return hashes[0], paths


def expected(docs):
    by_source = defaultdict(list)
    for d in docs:
        fields = [d[0], d[3], d[2], d[4]]
        lowered = None if d[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1])
        hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
        own = leaf(*fields, d[1])
        by_source[d[3]].append((d[0], own, leaf(*fields, lowered) if hit else own))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        members = sorted(by_source[s], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees.append((members, *grow([m[1] for m in members])))
    if not trees:
        return []
    root, tops = grow([t[1] for t in trees])
    out = []
    for (members, subroot, paths), top in zip(trees, tops, strict=True):
        for (doc_id, own, start), path in zip(members, paths, strict=True):
            h, seen = start, ""
            for pre, post in path + top:
                h = sha("".join(pre) + h + "".join(post))
                seen += "".join(pre + post)
            out.append((doc_id, own, subroot, root, sha(seen), h, h == root))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1, 257], [300, 0, 16, 1, 4097 // 16, 33], [1] * 40])
def test_manifest_like_a_plain_tree(spark, sizes):
    rng = random.Random(len(sizes))
    docs = [(rng.randrange(10**6), f"Text {rng.randrange(10**6)} É", "en", f"s{k:02}", 7) for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1, "x", 2, 3, "k") for d in docs], SCHEMA).repartition(3)
    assert got(merkle.manifest(df)) == sorted(expected(docs), key=str)


def test_nulls_ties_repeats_long_texts(spark):
    docs = [(None, None, None, None, None), (None, "A", "en", None, 1), (5, "", "", "", 0), (5, "B", "en", "é", None), (5, "B", "en", "é", None), (5, "C", "en", "é", 1)]
    docs += [(7, "same Text", "en", "hot", 9)] * 1500 + [(i, "Ü" * 300_000, "de", "z", 300_000) for i in range(3)] + [(2**62, "X", "en", "Z", 1)]
    df = spark.createDataFrame([(*d, 1, "x", 2, 3, "k") for d in docs], SCHEMA).repartition(5)
    assert got(merkle.manifest(df)) == sorted(expected(docs), key=str)
    assert merkle.manifest(df.limit(0)).collect() == []


def test_query(spark, small):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(queries.op11_merkle_manifest(spark, small)) == sorted(expected(docs), key=str)


def test_changed_siblings_do_not_verify(spark):
    rows = [(0, i, 20, sha(str(i))) for i in range(20)]
    levels = merkle.build_levels(spark.createDataFrame(rows, "tree long, idx long, n long, h string"))
    top = merkle.roots_of(levels).select("tree", F.array().cast(merkle.PATH).alias("path"), "root")
    found = merkle.proofs(levels, top)
    ok = merkle.folded(F.col("h"), F.col("path")) == F.col("root")
    assert found.where(ok).count() == 20
    swapped = F.transform("path", lambda s: F.struct(s["post"].alias("pre"), s["pre"].alias("post")))
    assert found.where(merkle.folded(F.col("h"), swapped) == F.col("root")).count() == 0
