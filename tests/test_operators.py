"""Fixed cases and brute-force versions of what SQL can't express."""

import json
import random
import re
import time
import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import json_fields as J
from millrace.functions import predicates, replies
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chunking, code_units, export, html_markdown, judging, lines, ranking, spans, tables, training_tokens, vector_search
from millrace.plans import registry
from millrace.sources import records
from millrace.streaming import incremental


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(column.alias("r")).first().r


@pytest.mark.parametrize("text,found", [("All rights reserved.", True), ("Telif hakkı saklıdır", True), ("indemnification", True), ("The licensee pays", False), ("a copyrighted", False), (None, False), ("", False)])
def test_boilerplate(spark, text, found):
    assert one(spark, T.is_boilerplate(F.col("t")), t=text) is found


def test_text_functions(spark):
    assert one(spark, T.strip(F.col("t")), t="  a b\n\n") == "a b"
    assert one(spark, T.strip_persona(F.col("t")), t="As a Senior engineer, I write.\n---\nBody") == "Body"
    assert one(spark, T.strip_line_numbers(F.col("t")), t="1 a\n2 b\nc") == "a\nb\nc"
    assert one(spark, T.slug(F.col("t")), t="  My Big Project ") == "my_big_project"
    assert one(spark, T.ocr_joined(F.col("t")), t="trans-\nistor a - b") == "transistor a - b"
    assert one(spark, replies.without_reasoning(F.col("t")), t="<think>hm</think>```json\n{}\n```") == "{}"
    assert [one(spark, T.knowledge_gain(F.lit(a), F.lit(b))) for a, b in (("a b", "A B"), ("a", "b"), ("", ""))] == [10, 95, 10]
    assert one(spark, T.preview(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, T.first_non_empty(F.lit(None).cast("string"), F.lit("  "), F.lit("x"))) == "x"


def test_dirty_json(spark):
    def pairs(j):
        return [tuple(p) for p in one(spark, J.question_answers(F.col("j")), j=j)]

    assert pairs('[{"question":" a ","answer":["x","y"]}, 3, {"question":{"text":"q"},"answer":"b"}, {"question":"","answer":"c"}]') == [("a", "x y"), ("q", "b")]
    assert pairs('{"question":"z","answer":7}') == [("z", "7")]
    for bad in ("oops", None, "null", "[]", ""):
        assert pairs(bad) == []
    assert one(spark, J.messages(F.col("j")), j='[{"role":"user"},{"role":"x","content":"y"}]') is None
    for broken, want in ((r'{"a": "\alpha"}', {"a": "\\alpha"}), ('```json\n{"a": 1,}\n```', {"a": 1}), ('so {"b":2} it is', {"b": 2})):
        assert json.loads(one(spark, J.healed(F.col("j")), j=broken)) == want
    assert one(spark, J.healed(F.col("j")), j="zzz") is None
    assert one(spark, J.tag_list(F.array().cast("array<string>"))) == "General"


def test_point_ids(spark):
    assert one(spark, V.point_id(F.col("n")), n="ölçü_chunk_3") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "ölçü_chunk_3"))


def test_strict_threshold(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "point_id long, vector array<float>")
    query = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    for threshold, hits in ((1.0, 0), (0.999, 1), (0.0, 1), (-1.0, 2), (-1.01, 3), (None, 3)):
        assert vector_search.nearest(points, query, 5, threshold=threshold).count() == hits
    assert vector_search.nearest(points, query, 0).count() == 0


def test_index_and_search(spark):
    docs = spark.createDataFrame([(1, "the red transistor"), (2, "a blue capacitor"), (3, None)], "id long, text string")
    chunks = vector_search.index_chunks(chunking.chunk_documents(docs, "id"), "id", vector_search.hashed_embedding())
    asked = chunks.where("id = 1").select(F.lit(0).cast("long").alias("query_id"), "vector")
    best = vector_search.nearest(chunks, asked, 1).first()
    assert best.point_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "1_chunk_0")) and best.score == pytest.approx(1)


def test_nearest_like_a_plain_loop_over_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SLICE", 7)
    monkeypatch.setattr(vector_search, "BLOCK", 3)
    monkeypatch.setattr(vector_search, "STRIP", 2)
    rng = random.Random(5)
    vectors = [[float(rng.randrange(-1, 3)) for _ in range(rng.choice([3, 3, 3, 4]))] for _ in range(60)]
    points = spark.createDataFrame(list(enumerate(vectors)), "point_id long, vector array<float>")
    queries = points.where("point_id % 5 = 0").withColumnRenamed("point_id", "query_id")
    size = lambda v: sum(x * x for x in v) ** 0.5
    for k, threshold, own in ((1, None, True), (4, None, True), (12, 0.2, False)):
        want = set()
        for q in range(0, 60, 5):
            near = [(i, sum(x * y for x, y in zip(v, vectors[q], strict=True)) / size(v) / size(vectors[q])) for i, v in enumerate(vectors) if len(v) == len(vectors[q]) and size(v) and size(vectors[q]) and (i != q or own)]
            near = sorted((-round(s, 9), i) for i, s in near if threshold is None or s > threshold)[:k]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
        got = vector_search.nearest(points, queries, k, threshold=threshold, leave_out_own=not own)
        assert {(r.query_id, r["rank"], r.point_id, round(r.score, 9)) for r in got.collect()} == want


def test_nearest_writes_in_proportion_to_points_and_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SLICE", 20)
    monkeypatch.setattr(vector_search, "BLOCK", 6)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((600, 64)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "point_id long, vector array<float>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    got = {r.query_id: r.point_id for r in vector_search.nearest(points, points.where("point_id % 5 = 0").withColumnRenamed("point_id", "query_id"), 1).collect()}
    time.sleep(1)
    assert got == {i: i for i in range(0, 600, 5)}
    # 30 slices and 20 blocks: a copy of each vector for all that it meets would be 20 and 30 times as much.
    assert 0 < written() - before < 720 * 64 * 4


@pytest.mark.parametrize("k,threshold,own,floors", [(1, None, False, True), (1, None, True, False), (3, 0.3, False, False), (3, None, True, False), (40, 0.8, False, False)])
def test_bounds_lose_no_near_point(monkeypatch, k, threshold, own, floors):
    for name, value in {"TILE": 16, "STRIP": 8, "LEVELS": (2, 6), "WORTH": 1, "FEW": 0.2}.items():
        monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((5, 24))
    vectors = (middles[rng.integers(5, size=400)] + rng.choice([0.02, 0.7], (400, 1)) * rng.standard_normal((400, 24))).astype(np.float32)
    # Equal vectors, vectors along another one, and those that take no part.
    vectors[50:110], vectors[200:220], vectors[300], vectors[301, 2] = vectors[0], vectors[5] * 2, 0, np.nan
    names = [f"{i * 7 % 400:03}" for i in range(400)]
    usable = [i for i in range(400) if i not in (300, 301)]
    with np.errstate(invalid="ignore"):
        unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    asked, want = [i for i in usable if i % 3 == 0], set()
    for q in asked:
        near = sorted((-round(float(unit[i] @ unit[q]), 9), names[i]) for i in usable if not (own and i == q) and (threshold is None or unit[i] @ unit[q] > threshold))
        want |= {(names[q], p, -s) for s, p in near[:k]}
    assert 0 < len(want) <= k * len(asked)

    def packs(rows, most, same, floor):
        schema = pa.schema({"_d": pa.int32(), "_i": pa.list_(pa.string()), "_f": pa.list_(pa.float64()), "_v": pa.binary()})
        table = pa.table({"_i": [names[i] for i in rows], "_f": pa.array(floor, pa.float64()), "_v": pa.array([[None if np.isnan(x) else x for x in vectors[i]] for i in rows], pa.list_(pa.float32()))})
        return pa.Table.from_batches(vector_search._packer(most, same, "f4", schema)(iter(table.to_batches(max_chunksize=90))), schema)

    floor = [max(float(unit[i] @ unit[q]) for i in usable[::9]) if floors else None for q in asked]
    queries = packs(asked, 30, None, floor)
    block = vector_search._block(SimpleNamespace(toArrow=lambda: queries), "f4")
    assert block.levels == (2, 6)
    points = packs(range(400), 150, None if own else k, [None] * 400)
    found = pa.schema({"_q": pa.string(), "_p": pa.string(), "score": pa.float64(), "_r": pa.float64()})
    score = vector_search._scorer(SimpleNamespace(value=block), k, threshold, own, "f4", found)
    got = pa.Table.from_batches(score(iter(points.select(["_i", "_v"]).to_batches())), found).to_pylist()
    assert {(r["_q"], r["_p"], r["_r"]) for r in got} == want and len(got) == len(want)


def test_rag_search_finds_the_nearest_of_all_chunks(spark, tmp_path):
    rng = random.Random(7)
    said = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    docs = [(i, said(rng.choice([40, 700]))) for i in range(1, 62)] + [(80, None), (100, " ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def embedded(text):
        v = np.zeros(512)
        for w in re.findall(r"\w+", text.lower()):
            h = xxhash.xxh64_intdigest(w)
            v[h % 512] += 1 if h >> 63 else -1
        return v / np.linalg.norm(v)

    chunks = [(f"{i}_chunk_{c['chunk_index']}", embedded(c["text"])) for i, t in docs for c in chunking.chunk_text(t)]
    want = {i: max((round(float(v @ embedded(t)), 9), n) for n, v in chunks) for i, t in docs if i % 20 == 0 and t and t.strip()}
    got = {r.query_id: r for r in registry.queries()["rag_search"](spark, str(tmp_path)).collect()}
    assert {i: (r.name, r["rank"], r.score) for i, r in got.items()} == {i: (n, 1, round(s, 3)) for i, (s, n) in want.items()}
    # A text of many chunks is asked for whole, so no chunk is equal to it.
    assert any(0 < r.score < 1 for r in got.values())


@pytest.mark.parametrize("limit,want", [(None, (0, None)), ("all", (0, None)), (0, (0, None)), ("-3", (0, None)), (7, (0, 7)), ("2:5", (2, 5)), ("4:", (4, None)), (":3", (0, 3))])
def test_limits(limit, want):
    assert ranking.parse_limit(limit) == want


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert ranking.with_position(df, "k").where("k <> position").count() == 0
    assert sorted(r.k for r in ranking.range_slice(df, "990:", "k").collect()) == list(range(990, 1000))


def brute_force_repeats(text):
    """Both rules as a plain loop over lines without tables."""
    out, last, n = [], None, 0
    for line in text.split("\n"):
        s = line.strip()
        if s:
            n = n + 1 if s == last else 1
            last = s
        if not s or n <= 2:
            out.append(line)
        elif n == 3:
            out.append(lines.RUN_MARKER)
    done, seen = [], {}
    for line in out:
        s = line.strip()
        seen[s] = seen.get(s, 0) + 1
        if len(s) <= 5 or [x.strip() for x in out].count(s) <= 4 or seen[s] <= 3:
            done.append(line)
        elif seen[s] == 4:
            done.append(f"*(Further repetitions of '{s}' truncated)*")
    return "\n".join(done).strip(" ")


def test_repetition_filter(spark):
    texts = ["a\na\na\na\nb\na", "same line\n" * 9, "x", "", "\n".join(["long line here", "other one here"] * 6), "q\n\nq\n\nq\n\nq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.text for r in lines.without_repeats(docs, "id").collect()}
    assert got == {i: brute_force_repeats(t) for i, t in enumerate(texts)}


def test_short_segments_merge(spark):
    parts = spark.createDataFrame([(1, "cover", 1, 1), (1, "preface", 2, 2), (1, "one", 3, 9), (1, "index", 10, 10), (2, "only", 1, 1)], "doc long, title string, start long, stop long")
    got = sorted((r.doc, r.title, r.start, r.stop) for r in lines.merge_short(parts, "doc", 3).collect())
    assert got == [(1, "cover / preface / one / index", 1, 10), (2, "only", 1, 1)]


def test_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 1.0, 9.0, 9.0), (1, 3, 20.0, 0.0, 30.0, 10.0), (1, 4, 500.0, 0.0, 510.0, 9.0)], "page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in lines.suppressed_boxes(boxes, ["page"]).collect()) == [1, 3, 4]
    assert sorted((r.x0, r.x1) for r in lines.grouped_boxes(boxes, ["page"]).collect()) == [(0.0, 30.0), (500.0, 510.0)]


def test_byte_coverage(spark):
    units = spark.createDataFrame([("a", 0, 9), ("a", 5, 14), ("a", 15, 19), ("b", 0, 9)], "path string, start long, stop long")
    files = spark.createDataFrame([("a", 40), ("b", 20)], "path string, size long")
    assert lines.byte_coverage(units, files, "path").first().asDict() == {"covered": 30, "size": 60, "percent": 50.0}


_words = st.text(alphabet="ab .!?\n|#-`1", max_size=400)


@settings(max_examples=150, deadline=None)
@given(_words, st.integers(5, 80))
def test_chunks_hold(text, size):
    chunks = chunking.chunk_text(text, size, size // 4)
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    for c in chunks:
        assert c["text"] and c["total_chunks"] == len(chunks) and c["end_char"] - c["start_char"] == len(c["text"])
        # the overlap, one unit at least, stays even where it and the next unit together are over the size
        assert len(c["text"]) <= 2 * size + 2 or "#" in c["text"]


def test_chunk_structure():
    assert chunking.chunk_text("Intro ..... 12\n. . . . 7") == [] and chunking.chunk_text(None) == []
    fence = "```py\n" + "    x = 1\n" * 5 + "```"
    assert chunking.chunk_text(f"Text.\n\n{fence}\n\nMore.")[0]["text"] == f"Text.\n\n{fence}\n\nMore."
    assert all("1.1V" in c["text"] or "133.5" in c["text"] or len(c["text"]) < 40 for c in chunking.chunk_text("It needs 133.5 mA at 1.1V. Then it stops. " * 3, 45, 5))
    assert len(chunking.chunk_text("Word here. " * 2000, 100, 10, 3)) == 3


def test_long_texts_are_chunked_whole(spark, tmp_path):
    text = " ".join(f"Sentence {i} has these words." for i in range(30000))
    chunks = chunking.chunk_text(text)
    assert len(chunks) > 500 and chunks[-1]["text"].endswith("Sentence 29999 has these words.")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["chunk_count"](spark, str(tmp_path)).first().chunks == len(chunks)


def test_token_rows(spark):
    sft = spark.createDataFrame([("s1", "ask", "", "answer"), ("s2", "ask", "", " ")], "id string, instruction string, input string, output string")
    row = training_tokens.token_rows(sft, "id").collect()
    assert [r.id for r in row] == ["s1"] and len(row[0].tokens) == len(row[0].loss_mask) == row[0].n_tokens
    assert bytes(t for t, m in zip(row[0].tokens, row[0].loss_mask, strict=True) if m) == b"answer\n" and row[0].loss_mask == sorted(row[0].loss_mask)
    assert training_tokens.token_rows(sft, "id", longest=10).count() == 0
    cut = training_tokens.token_rows(sft, "id", longest=row[0].n_prompt_tokens + 2).first()
    assert cut.truncated and cut.n_trainable_tokens == 2
    dpo = spark.createDataFrame([("p", "q", "good", "bad"), ("r", "q", "good", "")], "id string, prompt string, chosen string, rejected string")
    assert sorted((r.id, r.kind) for r in training_tokens.token_rows(dpo, "id").collect()) == [("p", "dpo_chosen"), ("p", "dpo_rejected"), ("r", "dpo_chosen")]


def test_token_query_keeps_whole_dialogues(spark, tmp_path):
    rows = [("a", 0, "user", "q" * 9000), ("a", 1, "assistant", "x" * 9000), ("b", 0, "user", "q"), ("b", 1, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in registry.queries()["token_mask_rows"](spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"].n_completion_tokens == 9001 and not got["a"].truncated
    sft = spark.createDataFrame([("s", "ask", "", "z" * 9000)], "id string, instruction string, input string, output string")
    cut = training_tokens.token_rows(sft, "id").first()
    assert cut.truncated and cut.n_tokens == 8192


def test_rows_of_many_dialogues_are_handed_on_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(training_tokens, "HELD", 30)
    docs = spark.createDataFrame([(i, "ask", "" if i % 7 else " ", "x" * i) for i in range(60)], "id long, instruction string, input string, output string").coalesce(1)
    got = {r.id: r for r in training_tokens.token_rows(docs, "id").collect()}
    assert set(got) == set(range(1, 60))
    assert all(bytes(t for t, m in zip(r.tokens, r.loss_mask, strict=True) if m) == b"x" * i + b"\n" for i, r in got.items())


def test_markdown_of_more_pages_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(html_markdown, "HELD", 3)
    pages = spark.createDataFrame([(i, None if i == 4 else f"<p>p{i}</p>") for i in range(11)], "id int, t string").coalesce(1)
    got = {r.id: r.m for r in pages.select("id", html_markdown.markdown(F.col("t")).alias("m")).collect()}
    assert got == {i: "" if i == 4 else f"p{i}" for i in range(11)}


def test_spans(spark):
    def at(text, quote):
        return tuple(one(spark, spans.located(F.col("t"), F.col("q")), t=text, q=quote))

    assert [at("Volt and volt", "volt"), at("abc DEF", "def"), at("a  b\nc", "b c"), at("abc", "zz"), at("a+b", "a+b")] == [(9, 13), (4, 7), (3, 6), (0, 2), (0, 3)]
    marked = spans.highlighted(F.col("t"), F.expr("array(named_struct('start_char', 0, 'end_char', 1), named_struct('start_char', 2, 'end_char', 3), named_struct('start_char', 2, 'end_char', 99))"))
    assert one(spark, marked, t="abc") == "<mark>a</mark>b<mark>c</mark>"
    docs = spark.createDataFrame([(1, "THE ESP32 runs at 3.3 V with SPI"), (2, None)], "id long, text string")
    got = sorted((r.text_span, r.entity_type) for r in spans.entities(docs, "id").collect())
    assert got == [("3.3 V", "spec_value"), ("ESP32", "component_ic"), ("SPI", "technical_term")]


def test_code(spark):
    files = spark.createDataFrame(
        [("a.py", b"\xef\xbb\xbfdef f():\r\n    return 1\n"), ("b.bin", b"x"), ("c.txt", b"\0\0\0"), (".git/x", b"x"), ("log/a.log", b"x"), ("log/keep.log", b"x"), ("n.md", None)], "path string, content binary"
    )
    got = {r.path: r.reason for r in code_units.with_reason(files, rules=["*.log", "!keep.log"]).collect()}
    assert got == {"a.py": None, "b.bin": "ext", "c.txt": "sniff", ".git/x": "exclude", "log/a.log": "gitignore", "log/keep.log": None, "n.md": "unreadable"}
    units = code_units.extract_units(files.select("path", code_units.normalized(F.col("content")).alias("text"))).collect()
    assert [(u.unit_type, u.name, u.line_count, u.byte_offset) for u in units] == [("function", "f", 2, 0)]
    assert code_units.python_units("def broken(:") == []


def test_html(spark):
    page = '<nav>menu</nav><h2>T</h2><p>a &amp; b</p><pre><code class="lang-py">x = 1</code></pre><ul><li>one<li>two</ul><script>no</script>'
    assert one(spark, html_markdown.wiki_markdown(F.col("t"), F.lit("x")), t=page) == "## T\n a & b\n\n```py\nx = 1\n```\n\n* one\n* two"
    asked = '<h1 id="question-header">Why?</h1><div id="question" data-score="14"><div class="post-text">body</div><a class="post-tag">led</a></div><div id="answer-1" class="answer accepted-answer" data-score="25"><div class="post-text">good</div></div><div id="answer-2" class="answer" data-score="1"><div class="post-text">bad</div></div>'
    r = html_markdown.question_pages(spark.createDataFrame([(asked,)], "html string")).select("*", export.ranked_answers(F.col("answers")).alias("k")).withColumn("bad", export.rejected_answer(F.col("k"), 2)).first()
    assert (r.title, r.tags, r.question_score, r.question_body, r.k[0].body, r.bad.body) == ("Why?", ["led"], 14, "body", "good", "bad")


def test_exports(spark):
    articles = spark.createDataFrame([(1, "Amplifier", 1990), (2, "Colophon", 1991), (3, "Other", None)], "id long, title string, year int")
    rows = [(1, "A summary that is long enough.", '[{"question":"q","answer":"a"},{"question":"copyright","answer":"b"}]', '{"question":"p","chosen":"c","rejected":"r"}', None, 0), (2, "x", '[{"question":"q","answer":"a"}]', None, None, 0), (3, "short", '[{"question":"q","answer":"a"}]', None, '[{"role":"user","content":"u"},{"role":"assistant","content":"v"}]', 1)]
    enrichments = spark.createDataFrame(rows, "article_id long, summary string, sft_qa string, dpo_pairs string, multi_turn_chat string, is_excluded int")
    sets = export.export_sets(articles, enrichments, "Demo", "en")
    assert {k: v.count() for k, v in sets.items()} == {"sft_dataset": 2, "dpo_dataset": 1, "chat_dataset": 1}
    assert all(r.input == "" for r in sets["sft_dataset"].collect())


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, u string, v string")
    new = spark.createDataFrame([(2, "c", "y"), (3, None, "z")], "id long, u string, v string")
    assert sorted(map(tuple, tables.upsert(old, new, "id", ("u",)).collect()), key=str) == [(1, "a", "x"), (2, "b", "y"), (3, None, "z")]
    empty = spark.createDataFrame([], "old_id long, new_id long")
    assert tables.remap_ids(old, "id", empty).count() == 2
    schema = StructType.fromDDL("id int, extra double, u string")
    assert tables.conform(old, schema).first().asDict() == {"id": 1, "extra": None, "u": "a"}
    pairs = spark.createDataFrame([("short", ""), ("a long enough answer", "A LONG enough answer "), ("a long enough answer", "other")], "chosen string, rejected string")
    assert [r.judge_status for r in judging.judged(pairs).collect()] == ["rejected", "rejected", "approved"]


def test_records(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([('{"instruction":"a","output":"b"}',), ("broken",), ("",), ('{"instruction":" ","output":"b"}',)], "value string").coalesce(1).write.text(path)
    df = records.read_json_lines(spark, path, StructType.fromDDL("instruction string, output string"))
    assert df.count() == 2 and records.write_records(df, str(tmp_path / "out")) and spark.read.parquet(str(tmp_path / "out.parquet")).count() == 1
    assert not records.write_records(df.where("false"), str(tmp_path / "none"))


def test_stream_upserts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, at long, v string")
    for part in (rows, spark.createDataFrame([(1, 2, "c")], rows.schema)):
        part.coalesce(1).write.mode("append").parquet(source)
        query = incremental.run_pending(incremental.follow(spark, source, rows.schema), incremental.upsert_batches(target, ["id"], ["at"]), str(tmp_path / "cp"))
        query.awaitTermination()
    assert sorted((r.id, r.v) for r in incremental.current(spark, target, ["id"], ["at"]).collect()) == [(1, "c"), (2, "b")]


def test_html_keeps_code_and_passes_over_nested_parts(spark):
    html = "<div class='navbox'><div>x</div>gone</div><p>a<script>b</script></p><pre><code class='language-c'>if (a &lt; b) <b>c</b>;</code></pre><p>x <code>y<i>z</i></code> <span class='math-container'>e=1</span></p>"
    got = one(spark, html_markdown.wiki_markdown(F.col("t"), F.lit("")), t=html)
    assert [line.strip() for line in got.split("\n") if line.strip()] == ["a", "```c", "if (a < b) c;", "```", "x `yz`  $e=1$"]


def test_streams_follow_tables_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "view", 2.0, 7), (2, "2024-01-01 11:00:00", "view", 3.0, 7)], "event_id long, ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.n, r.total) for r in registry.queries()["stream_daily_windows"](spark, str(tmp_path)).collect()] == [(2, 5.0)]


def test_strict_inputs(spark):
    with pytest.raises(ValueError):
        predicates.of_types(F.col("t"), ["function", "verse"])
    with pytest.raises(Exception, match="unknown language"):
        one(spark, tables.normalised(F.col("t"), {"en": "english"}, "language"), t="xx")


def test_deep_pages_and_long_slices(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_TASK", 20)
    df = spark.range(100).repartition(5)
    assert sorted(r.id for r in ranking.page(df, 5, 10, "id").collect()) == list(range(40, 50))
    assert sorted(r.id for r in ranking.range_slice(df, 50, "id").collect()) == list(range(50))
    assert [r.id for r in ranking.page(df, 1, 10, "id").collect()] == list(range(10))
