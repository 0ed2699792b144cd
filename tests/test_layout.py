"""Page geometry against plain loops: gutters, reading order, paragraphs, free boxes, captions, stitching."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import layout, lines
from millrace.plans import registry

LINE = "doc_id long, page long, item_id long, x0 double, y0 double, x1 double, y1 double, size double, kind string, text string"


def plain_gutters(items, width):
    """Gutters by an array of points."""
    bins = [0] * int(width)
    for i in items:
        if i["x1"] - i["x0"] <= 0.6 * width and i["size"] <= 13:
            for x in range(max(0, int(i["x0"])), min(int(width), int(i["x1"]))):
                bins[x] += 1
    lo, hi = int(0.15 * width), int(0.85 * width)
    out, x = [], lo
    while x < hi:
        end = x
        while end < hi and not bins[end]:
            end += 1
        if end - x >= 12 and sum(i["x1"] <= x + 3 for i in items) >= 2 and sum(i["x0"] >= end - 3 for i in items) >= 2:
            out.append((x, end))
        x = max(end, x + 1)
    return out


def plain_order(items, gutters, width):
    mids = [(a + b) / 2 for a, b in gutters]
    if not mids:
        return [i["item_id"] for i in sorted(items, key=lambda i: (i["y0"], i["item_id"]))]
    spanning = [i for i in items if i["x1"] - i["x0"] > width / 2 or any(i["x0"] < m < i["x1"] for m in mids)]
    rest = [i for i in items if i not in spanning]
    out = []

    def columns(band):
        for c in range(len(mids) + 1):
            out.extend(sorted((i for i in band if sum(m < (i["x0"] + i["x1"]) / 2 for m in mids) == c), key=lambda i: (i["y0"], i["item_id"])))

    for s in sorted(spanning, key=lambda i: (i["y0"], i["item_id"])):
        columns([i for i in rest if i["y0"] < s["y0"]])
        rest = [i for i in rest if i["y0"] >= s["y0"]]
        out.append(s)
    columns(rest)
    return [i["item_id"] for i in out]


def page_items(rng, page, columns):
    pitch = 500 / columns
    out = []
    for k in range(rng.randrange(3, 40)):
        x0 = 45 + rng.randrange(columns) * pitch + rng.randrange(5)
        x1 = x0 + rng.randrange(20, int(pitch) - 14)
        if rng.random() < 0.1:
            x0, x1 = 45.0, 45.0 + rng.randrange(250, 500)
        y0 = float(rng.randrange(0, 780, 5))
        out.append((1, page, k, float(x0), y0, float(x1), y0 + 9, rng.choice([10.0, 10.0, 10.0, 16.0]), "line", f"t{k}"))
    return out


def test_gutters_and_order_like_plain_loops(spark):
    rng = random.Random(4)
    rows = [r for page in range(40) for r in page_items(rng, page, 1 + page % 3)]
    items = spark.createDataFrame(rows, LINE)
    gutters = layout.column_gutters(items, F.lit(595.0))
    got, order = {}, {}
    for r in gutters.collect():
        got.setdefault(r.page, []).append((r.g0, r.g1))
    for r in layout.reading_order(items, gutters, F.lit(595.0)).orderBy("page", "position").collect():
        order.setdefault(r.page, []).append(r.item_id)
    names = LINE.replace(",", "").split()[::2]
    seen = set()
    for page in range(40):
        plain = [dict(zip(names, r, strict=True)) for r in rows if r[1] == page]
        want = plain_gutters(plain, 595.0)
        seen.add(len(want))
        assert sorted(got.get(page, [])) == want
        assert order[page] == plain_order(plain, want, 595.0)
    assert seen >= {0, 1, 2}


def test_three_columns_and_a_header_between(spark):
    rows, text = [], {}

    def put(x, y, t, width=80, size=10.0):
        text[len(rows)] = t
        rows.append((1, 1, len(rows), float(x), float(y), float(x + width), y + 9.0, size, "line", t))

    for y in (100, 130):
        for c, x in enumerate((50, 220, 400)):
            put(x, y, f"c{c}-{y}")
    put(50, 180, "middle title", 450, 14.0)
    put(220, 220, "after-1")
    put(50, 220, "after-0")
    items = spark.createDataFrame(rows, LINE)
    ordered = layout.reading_order(items, layout.column_gutters(items, F.lit(600.0)), F.lit(600.0))
    got = [text[r.item_id] for r in ordered.orderBy("position").collect()]
    assert got == ["c0-100", "c0-130", "c1-100", "c1-130", "c2-100", "c2-130", "middle title", "after-0", "after-1"]
    assert layout.column_gutters(items.limit(0), F.lit(600.0)).collect() == []


def test_paragraphs(spark):
    typed = [("line", "# Head", 10.0), ("line", "The trans-", 10.0), ("line", "istor works", 10.0), ("line", "well.", None), ("line", " ", 10.0), ("table", "| a |", None), ("line", "no 3-", 10.0), ("line", "phase", 10.0), ("line", "Big", 14.0), ("line", None, 9.0)]
    rows = [(1, 1, i, k, t, s) for i, (k, t, s) in enumerate(typed)]
    found = layout.paragraphs(spark.createDataFrame(rows, "doc_id long, page long, position long, kind string, text string, size double"))
    assert [(r.paragraph, r.text) for r in found.orderBy("paragraph").collect()] == [(1, "# Head"), (2, "The transistor works well."), (3, "| a |"), (4, "no 3- phase"), (5, "Big")]


def plain_trim(rect, core, masks):
    cx, cy = (core[0] + core[2]) / 2, (core[1] + core[3]) / 2

    def holds(b):
        return b[0] <= cx < b[2] and b[1] <= cy < b[3]

    def area(b):
        return (b[2] - b[0]) * (b[3] - b[1])

    for _ in range(4):
        hits = [m for m in masks if min(m[2], rect[2]) > max(m[0], rect[0]) and min(m[3], rect[3]) > max(m[1], rect[1])]
        if not hits:
            return rect
        b = (min(m[0] for m in hits), min(m[1] for m in hits), max(m[2] for m in hits), max(m[3] for m in hits))
        if holds(b):
            return None
        x0, y0, x1, y1 = rect
        kept = [k for k in ((x0, y0, x1, b[1]), (x0, b[3], x1, y1), (x0, y0, b[0], y1), (b[2], y0, x1, y1)) if k[2] - k[0] >= 36 and k[3] - k[1] >= 36 and holds(k)]
        if not kept:
            return None
        best = max(kept, key=area)
        if area(best) < 0.25 * area(rect) or area(best) < 0.25 * max(area(core), 1):
            return None
        rect = best
    return None


@pytest.mark.parametrize("seed", range(2))
def test_boxes_free_of_masks(spark, seed):
    rng = random.Random(seed)

    def box(most):
        x, y = rng.randrange(400), rng.randrange(500)
        return (float(x), float(y), float(x + rng.randrange(5, most)), float(y + rng.randrange(5, most)))

    cases = []
    for _ in range(300):
        core = box(150)
        cases.append((core, tuple(c + d for c, d in zip(core, (-60, -60, 60, 60), strict=True)), [box(200) for _ in range(rng.randrange(6))]))
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([(i, c, r, m) for i, (c, r, m) in enumerate(cases)], f"i int, core {kind}, rect {kind}, masks array<{kind}>")
    got = {r.i: r.f and tuple(r.f) for r in df.select("i", layout.free_of_masks(F.col("rect"), F.col("core"), F.col("masks")).alias("f")).collect()}
    want = {i: plain_trim(r, c, m) for i, (c, r, m) in enumerate(cases)}
    assert got == want
    assert sum(v is None for v in want.values()) > 20 and sum(v is not None and v != cases[i][1] for i, v in want.items()) > 20


def test_captions_go_on_below(spark):
    box = "doc_id long, page long, {}, x0 double, y0 double, x1 double, y1 double"
    found = spark.createDataFrame([(1, 1, 1, 100.0, 200.0, 300.0, 300.0), (1, 2, 3, 0.0, 0.0, 9.0, 9.0), (2, 1, 4, 0.0, 0.0, 9.0, 9.0)], box.format("table_id long"))
    rows = [(1, 1, "Table 1 near", 100.0, 170.0, 200.0, 180.0), (1, 1, "goes  on", 100.0, 182.0, 200.0, 190.0), (1, 1, "inside", 150.0, 210.0, 200.0, 220.0), (1, 1, "Table 9 in the margin", 100.0, 20.0, 200.0, 30.0), (3, 1, "Table 9", 0.0, 60.0, 1.0, 61.0)]
    blocks = spark.createDataFrame(rows, box.format("text string"))
    assert sorted((r.table_id, r.caption) for r in layout.nearest_captions(found, blocks).collect()) == [(1, "Table 1 near goes on"), (3, None), (4, None)]


def test_running_lines(spark):
    rows = [(44.0, 60.0, "words"), (60.0, 70.0, "RP2040 Datasheet"), (60.0, 70.0, "words"), (792.0, 799.0, "words"), (770.0, 779.0, "12"), (770.0, 779.0, "2.5. DMA Controller 112"), (770.0, 779.0, "words"), (51.0, 60.0, None)]
    df = spark.createDataFrame(rows, "y0 double, y1 double, text string")
    got = [r[0] for r in df.select(layout.is_running_line(F.col("y0"), F.col("y1"), F.lit(842.0), F.col("text"))).collect()]
    assert got == [True, True, False, True, True, True, False, False]


@pytest.mark.parametrize(
    "pages, want",
    [
        (["The trans-", "istor works well.", "New part", None], "The transistor works well.\n\nNew part"),
        (["an open end and", "goes on"], "an open end and goes on"),
        (["| a |", "goes on"], "| a |\n\ngoes on"),
        (["text and", "| a |"], "text and\n\n| a |"),
        (["code\n```", "goes on"], "code\n```\n\ngoes on"),
        (["text and", "# head"], "text and\n\n# head"),
        (["| a", "b", "c"], "| a\n\nb c"),
        (["x", " ", "", "y"], "x y"),
        ([""], None),
    ],
)
def test_stitching(spark, pages, want):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "doc long, page int, text string")
    got = lines.stitched_pages(df, "doc").collect()
    assert [r.text for r in got] == ([] if want is None else [want])


def test_grouped_boxes_with_shared_ids_and_no_page(spark, tmp_path):
    # Of order 1 two lines have one id and lie apart; order 2 has two ids apart; the last lines have no order.
    rows = [(1, 3, 1, 1, 5.0), (1, 3, 10, 1, 5.0), (2, 3, 1, 1, 5.0), (2, 3, 10, 2, 5.0), (None, 1, 1, 1, 5.0), (None, 1, 1, 2, 5.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["grouped_boxes"]).fetchall()
    got = registry.queries()["grouped_boxes"](spark, str(tmp_path)).select("page", "x0", "y0", "x1", "y1").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3
