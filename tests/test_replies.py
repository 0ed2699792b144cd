"""Cleaning of replies and scans: nested and open regions, headers, monologues; the dictionary of corrections."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import predicates, replies
from millrace.plans import registry


def on(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.out for r in df.select("i", column(F.col("t")).alias("out")).orderBy("i").collect()]


def plain_regions(text, opening, closing):
    """Innermost regions go until none is left, then what follows an open mark."""
    inner = re.compile(f"{opening}(?:(?!{opening}).)*?{closing}", re.S)
    while inner.search(text):
        text = inner.sub("", text)
    return re.sub(f"{opening}.*$", "", text, flags=re.S)


def test_regions_like_repeated_removal(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<t>", "</t>", "a", "b ", "\n"]) for _ in range(rng.randrange(14))) for _ in range(300)] + [None, "", "x"]
    got = on(spark, lambda c: replies.without_regions(c, "<t>", "</t>"), texts)
    assert got == [t and plain_regions(t, "<t>", "</t>") if t else t for t in texts]


@pytest.mark.parametrize(
    "reply, want",
    [
        ("<think>a<think>b</think>secret</think>answer", "answer"),
        ("<think><think>sub</think>outer</think>\n# Map\nValid.", "# Map\nValid."),
        ("Preamble.\n<think>on registers\n# Header\nData.", "Preamble."),
        ("<｜thought｜>a<｜thought｜>b<｜end of thought｜>c<｜end of thought｜>d", "d"),
        ("<|start_header_id|>assistant<|end_header_id|>\nOutput.", "Output."),
        ("<|start_header_id|>system<|end_header_id|>\nHelp.<|eot_id|>\n# Real", "Help.\n# Real"),
        ("【x】<|im_start|>assistant Yes<|im_end|></think>", "Yes"),
        ("<|file:users.md:1:1|>Text", "Text"),
        ("Let me look at it.\nStill so.\n\nThe table", "The table"),
        ("First, the user wants a list.\n## List\nx", "## List\nx"),
        ("Plain words.\n## List\nx", "Plain words.\n## List\nx"),
        (None, ""),
        ("", ""),
    ],
)
def test_replies(spark, reply, want):
    assert on(spark, replies.clean_reply, [reply]) == [want]


def test_reasoning_before_json(spark):
    assert on(spark, replies.without_reasoning, ["<thinking>a<think>b</think>c</thinking>```json\n{}\n```", "{}"]) == ["{}", "{}"]


def test_scans(spark):
    texts = ["impa- \n ratorluk", "medeni yeti", "kitap lar", "pin ten", "pin ten çok", "kara den çok", "kara den", "c1rcu1ts C1RCU1T xc1rcu1t", "Circu it circu it", "S. lll.x S. lll. ", "Tep de vri İke suslar", None, "", "x" * 100_000 + " d1g1tal"]
    want = ["imparatorluk", "medeniyeti", "kitaplar", "pin ten", "pin ten çok", "karaden çok", "kara den", "circuits circuit xc1rcu1t", "Circu it circuit", "S. III.x S. lll. ", "Teb devri İksoslar", None, "", "x" * 100_000 + " digital"]
    assert on(spark, replies.clean_scan, texts) == want


def test_replacements_are_not_searched_again(spark):
    assert on(spark, lambda c: replies.replaced_once(c, [("ab", "b"), ("bb", "x"), ("b", "ab")]), ["abbb b", "none"]) == ["bx ab", "none"]


def test_code_language(spark):
    assert on(spark, predicates.code_language, ["def f():", "def f(): // c", "int x", "", "x == 1", None]) == ["python", "c", "c", "c", "c", "c"]


def plain_scan(text):
    """One replacement after another over the whole text."""
    letters = "a-zA-ZçğıöşüÇĞİÖŞÜ"
    text = re.sub(r"(\w+)-\s*\n\s*(\w+)", r"\1\2", text)
    text = re.sub(rf"(\b[{letters}]{{3,}})\s+({replies.SUFFIXES})\b", r"\1\2", text, flags=re.I)
    turkish = re.search("[çğıöşüÇĞİÖŞÜ]", text) is not None
    text = re.sub(rf"(\b[{letters}]{{3,}})\s+({replies.DOUBTFUL_SUFFIXES})\b", lambda m: m[1] + m[2] if turkish and m[1].lower() not in replies.NO_STEMS else m[0], text, flags=re.I)
    for p, r in replies.CORRECTIONS:
        exact = p.startswith("(?-i:")
        text = re.sub(p[5:-1] if exact else p, r, text, flags=0 if exact else re.I)
    return text


def test_scan_query_like_one_replacement_after_another(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL").collect()}
    got = {r.doc_id: r.cleaned for r in registry.queries()["scan_cleaning"](spark, small).collect()}
    head = "The c1rcu1t of {} with AMPL1F1ER {} and transi stor, broken li-\n  nes lik; pin ten, {}. {}"
    assert got == {i: plain_scan(head.format(d.lang, i, d.source, d.text)) for i, d in docs.items()}


def test_every_correction_is_found_where_it_may_begin(spark):
    plain = {"(?-i:": "", ")": "", r"\b": "", r"['’\s]*": "'", r"\s+": " ", r"\s*": " ", r"\.": ".", "?": ""}
    words = []
    for p, _ in replies.CORRECTIONS:
        for old, new in plain.items():
            p = p.replace(old, new)
        words.append(p)
    texts = [f"so {w} it" for w in words] + [f"x{w}" for w in words]
    got = on(spark, lambda c: replies.replaced_once(c, replies.CORRECTIONS, starts=replies.CORRECTED), texts)
    assert got == on(spark, lambda c: replies.replaced_once(c, replies.CORRECTIONS), texts)
    # A point at the end of a word isn't followed by a word's bound here.
    assert sum(g != t for g, t in zip(got, texts, strict=True)) >= len(words) - 2
