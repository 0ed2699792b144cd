"""The filter audit against all orders applied one by one."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from millrace.llm import filter_audit, queries

SCHEMA = "doc_id long, text string, source string, part int, mask string, n int, good int, toxic int"


def expected(docs, labels):
    """(part, order, step) -> the counts, by filtering lists. docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        parts[s or ""].append(({k for k, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                total[f] += len(gone)
                failing = [r for r in rows if f in r[0]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(len(r[0]) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return out


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1, "x", 2, 3, 4) for d in docs], SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("seed", range(2))
def test_like_filtering_lists(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#y", "o"] + [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words[: rng.choice([3, 300])], k=rng.choice([5, 199, 200, 260]))) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert got(filter_audit.audit_documents(*frames(spark, docs, labels))) == expected(docs, labels)


def test_nulls_ties_hot_rows_and_long_texts(spark):
    docs = [(None, None, None), (None, "one text", "a"), (9, None, "b"), (3, "", "a"), (3, "", "a"), (3, "one text", "b"), (1, "one text", "a"), (2, "Long Word " * 200_000, "c")]
    docs += [(7, "Hot text", "hot")] * 900 + [(8, f"text {k}", "hot") for k in range(900)]  # repeated rows, and one id with many texts
    labels = [(7, 1, 0), (8, 0, 1), (8, 1, 0), (3, 1, 1)]
    assert got(filter_audit.audit_documents(*frames(spark, docs, labels))) == expected(docs, labels)


def test_empty_table(spark):
    docs, labels = frames(spark, [(1, "a", "b")], [(1, 1, 1)])
    assert filter_audit.audit_documents(docs.limit(0), labels).collect() == []
    assert {r.good_lost for r in filter_audit.audit_documents(docs, labels.limit(0)).collect()} == {0}


def test_words_end_at_the_six_white_characters_only(spark):
    text = "a b c\x0bd\x1ce f"
    docs, labels = frames(spark, [(1, " ".join([text] * 70), "p")], [])
    assert got(filter_audit.audit_documents(docs, labels)) == expected([(1, " ".join([text] * 70), "p")], [])


def test_query(spark, small):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(queries.op13_filter_audit(spark, small)) == expected(docs, labels)
