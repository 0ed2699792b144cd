"""Chapters of books: nested titles against a recursive walk, headings, slices."""

import random

from pyspark.sql import functions as F

from millrace.operators import chapters

NODE = "doc_id long, pos int, title string, depth int, page long"


def walked(nodes):
    """Titles by going back from each node: the nearest earlier node with less depth is its parent; unknown pages give no title."""
    out = []
    for i, (_, pos, title, depth, page) in enumerate(nodes):
        if page is None:
            continue
        above, d, j = [], depth or 0, i - 1
        while j >= 0:
            if (nodes[j][3] or 0) < d:
                d = nodes[j][3] or 0
                if nodes[j][4] is not None:
                    above.append(nodes[j][2] or "")
            j -= 1
        full = ""
        for t in [*reversed(above), title or ""]:
            full = f"{full} - {t}" if full else t
        out.append((pos, full))
    return out


def test_nested_titles_as_a_walk_gives(spark):
    rng = random.Random(5)
    rows = [(d, p, rng.choice(["A", "B", "", None, "C c"]), rng.choice([0, 0, 1, 2, 3, None]), rng.choice([None, p, p, p])) for d in range(30) for p in range(rng.randrange(1, 15))]
    got = chapters.nested_titles(spark.createDataFrame(rows, NODE)).collect()
    for d in range(30):
        mine = sorted((r.pos, r.title) for r in got if r.doc_id == d)
        assert mine == walked([r for r in rows if r[0] == d])
    assert chapters.nested_titles(spark.createDataFrame([], NODE)).count() == 0


def books(spark):
    pages = [(1, p, "words") for p in range(10)]
    pages += [(2, p, {2: "\n\n CHAPTER 1: ONE \nx", 5: "a\nb\nPart two three", 6: "a\nb\nc\nCHAPTER 9 far", 7: None}.get(p, "plain")) for p in range(9)]
    pages += [(3, p, "") for p in range(31)] + [(4, 0, "one")]
    return spark.createDataFrame(pages, "doc_id long, page long, text string")


def test_ways_of_cutting(spark):
    outline = [(1, 0, "One", 0, 2), (1, 1, "a", 1, 2), (1, 2, "b", 1, 4), (1, 3, "Two", 0, 6), (1, 4, "Beyond", 0, 10), (4, 0, "Lost", 0, 7)]
    nodes = spark.createDataFrame(outline, NODE)

    def cut(**options):
        return {(r.doc_id, r.title, r.start, r.stop, r.found_by) for r in chapters.book_segments(books(spark), nodes, **options).collect()}

    rest = {(2, "CHAPTER 1: ONE", 2, 4, "headings"), (2, "Part two three", 5, 8, "headings"), (3, "Section starting page 1", 0, 14, "slices")}
    rest |= {(3, "Section starting page 16", 15, 29, "slices"), (3, "Section starting page 31", 30, 30, "slices"), (4, "Section starting page 1", 0, 0, "slices")}
    assert cut() == rest | {(1, "One", 2, 3, "outline"), (1, "One - b", 4, 5, "outline"), (1, "Two", 6, 9, "outline")}
    assert cut(max_depth=0) == rest | {(1, "One", 2, 5, "outline"), (1, "Two", 6, 9, "outline")}
    deep = spark.createDataFrame([(1, 0, "x", 2, 1)], NODE)
    assert [tuple(r) for r in chapters.book_segments(books(spark), deep, max_depth=0).where("doc_id = 1").collect()] == [(1, "x", 1, 9, "outline")]


def test_empty_tables(spark):
    none = books(spark).where(F.lit(False))
    assert chapters.book_segments(none, spark.createDataFrame([], NODE)).count() == 0
