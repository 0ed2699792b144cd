"""Held-out accuracy and defined results of the compression-distance classifier."""

import random
import zlib

from pyspark.sql import functions as F

from millrace.llm import toxicity

BAD = ["grumblescum", "vilethorn", "nastoid", "blightworm"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "the", "ing", "er", "on", "re", "st", "ou", "ble", "ti", "ha", "en"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            ws[rng.randrange(len(ws))] = rng.choice(BAD).upper() + rng.choice(["", ",", "!"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS toxic").drop("score")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    test = [(got[i] >= 0.5, y == 1) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in test) >= 0.97 * len(test)
    assert all(0 <= s <= 1 for s in got.values())


def test_whole_texts_count(spark):
    rows, labels = corpus(200, 2)
    model = toxicity.fit(*[[toxicity.windows(t) for (i, t), (_, y) in zip(rows, labels, strict=True) if y == v] for v in (1, 0)])
    clean = rows[1][1]
    docs = spark.createDataFrame([(1, clean), (2, " ".join([clean] * 5 + BAD * 4)), (3, None), (4, ""), (5, "?!"), (5, "?!")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert got[1] < 0.5 < got[2] and got[3] == got[4] == got[5] < 0.5


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(7, 0), (8, 1)], [(1, None), (None, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.scored(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.scored(docs.limit(0), model).collect() == []
