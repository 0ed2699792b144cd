"""Page geometry over tables of extracted lines and boxes (doc_id, page, x0, y0, x1, y1, ...), in points from the top left."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

PAGE = ("doc_id", "page")
# Margins in points, shares and sizes by which running lines, code, figures, columns and free bands are told.
HEADER_END, HEADER_START, FOOTER, NEAR_END = 50.0, 45.0, 50.0, 75.0
MONO_SHARE = 0.65
FIGURE_AREA, FIGURE_PAGE_SHARE, FIGURE_ASPECT, FIGURE_PATHS = 2000.0, 0.85, (0.05, 20.0), 4
CAPTION_LEFT, CAPTION_TOP, CAPTION_ABOVE, CAPTION_UNDER, CAPTION_GAP, CAPTION_BELOW = 25.0, 45.0, 50.0, 10.0, 25.0, 15.0
GUTTER_ZONE, GUTTER_WIDTH, GUTTER_SLACK, GUTTER_LINES = (0.15, 0.85), 12, 3.0, 2
COLUMN_LINE, COLUMN_SIZE, SPANNING, HEADING_SIZE = 0.60, 13.0, 0.50, 13.0
TRIM_PASSES, TRIM_SIDE, TRIM_SHARE = 4, 36.0, 0.25
RUNNING_TITLES = (r"(?i)RP[0-9]{4}\s+Datasheet", r"(?i)Raspberry\s+Pi")
_CAPTION = r"(?i)(?:Table|Tablo|Figure|Şekil)\s+\d+"
_CODE_TOKENS = ("#include", "dma_", "{", "}", ";")


def is_running_line(y0: Column, y1: Column, height: Column, text: Column, titles: tuple[str, str] = RUNNING_TITLES) -> Column:
    """FLT-13: a header or footer by its place, or near an end by its words: a running title (the second kind under 40
    characters only) at the top, a page number or a numbered section title with one at the bottom."""
    t = T.strip(F.coalesce(text, F.lit("")))
    title = t.rlike(titles[0]) | (t.rlike(titles[1]) & (F.length(t) < 40))
    number = t.rlike(r"^\d+$") | t.rlike(r"(?U)^[0-9.]+\s+[\w\s]+\s+\d+$")
    header = (y1 <= HEADER_END) | (y0 < HEADER_START) | ((y0 <= NEAR_END) & title)
    footer = (y0 >= height - FOOTER) | ((y0 >= height - NEAR_END) & number)
    return F.coalesce(header | footer, F.lit(False))


def is_figure(x0: Column, y0: Column, x1: Column, y1: Column, page_area: Column, paths: Column) -> Column:
    """FLT-31: neither tiny nor the whole page, no thin line, and of several drawn paths."""
    w, h = x1 - x0, y1 - y0
    aspect = w / F.nullif(h, F.lit(0.0))
    area = w * h
    sound = (area >= FIGURE_AREA) & (area <= page_area * FIGURE_PAGE_SHARE) & aspect.between(*FIGURE_ASPECT) & (paths >= FIGURE_PATHS)
    return F.coalesce(sound, F.lit(False))


def mono_lines(spans: DataFrame, line: list[str]) -> DataFrame:
    """FLT-37: lines (the columns ``line``) with is_mono: at least MONO_SHARE of the characters of its spans (text, mono) are
    of a fixed-width font."""
    chars = F.length(F.coalesce("text", F.lit("")))
    share = F.try_divide(F.sum(F.when(F.col("mono"), chars).otherwise(0)), F.sum(chars))
    return spans.groupBy(*line).agg(F.coalesce(share >= MONO_SHARE, F.lit(False)).alias("is_mono"))


def _any_of(column: str, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found |= F.contains(F.col(column), F.lit(w))
    return F.coalesce(found, F.lit(False))


def code_islands(lines: DataFrame, key: list[str], order: str) -> DataFrame:
    """WN-18: key, first, n of runs of fixed-width lines (is_mono, text): two lines at least, or one that looks like code."""
    w = Window.partitionBy(*key).orderBy(order)
    # Lines of other kinds number the runs: inside a run their count doesn't change.
    placed = lines.withColumn("_run", F.sum(F.when(F.col("is_mono"), 0).otherwise(1)).over(w)).where("is_mono")
    runs = placed.groupBy(*key, "_run").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.bool_or(_any_of("text", _CODE_TOKENS)).alias("_code"))
    return runs.where((F.col("n") >= 2) | F.coalesce("_code", F.lit(False))).select(*key, "first", "n")


def inside_regions(lines: DataFrame, regions: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """JN-12: lines with the region (of its page) in whose rectangle their midpoint lies; the smallest region_id of several.

    The join is by page; the rectangle is its residual condition.
    """
    r = regions.select(*key, "region_id", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    met = lines.join(r, list(key)).where(mid_x.between(F.col("r_x0"), F.col("r_x1")) & mid_y.between(F.col("r_y0"), F.col("r_y1")))
    return met.groupBy(*lines.columns).agg(F.min("region_id").alias("region_id"))


def projection(lines: DataFrame, width: Column, key: tuple[str, ...] = PAGE) -> DataFrame:
    """MH-07: the histogram of a page's text lines over x: key, width, x, until, cover; every point in [x, until) is under ``cover`` lines.

    Lines wider than COLUMN_LINE of the page or set larger than COLUMN_SIZE don't count. A line covers whole points; it adds
    one where it starts and takes one off where it ends, and the running sum is the histogram, so a page costs as many rows
    as it has line ends, not points. The empty ends of the page are part of it.
    """
    start, end = F.greatest(F.lit(0), F.col("x0").cast("int")), F.least(F.col("_width").cast("int"), F.col("x1").cast("int"))
    paged = lines.withColumn("_width", width.cast("double"))
    counted = paged.where((F.col("x1") - F.col("x0") <= F.col("_width") * COLUMN_LINE) & (F.coalesce("size", F.lit(10.0)) <= COLUMN_SIZE) & (start < end))
    ends = counted.select(*key, "_width", F.explode(F.array(F.struct(start.alias("x"), F.lit(1).alias("d")), F.struct(end.alias("x"), F.lit(-1).alias("d")))).alias("e")).select(*key, "_width", "e.*")
    border = paged.groupBy(*key).agg(F.max("_width").alias("_width")).select(*key, "_width", F.explode(F.array(F.lit(0), F.col("_width").cast("int"))).alias("x"), F.lit(0).alias("d"))
    steps = ends.unionByName(border).groupBy(*key, "x").agg(F.max("_width").alias("width"), F.sum("d").alias("d"))
    along = Window.partitionBy(*key).orderBy("x")
    runs = steps.select(*key, "width", "x", F.lead("x").over(along).alias("until"), F.sum("d").over(along).alias("cover"))
    return runs.where(F.col("until").isNotNull())


def column_gutters(lines: DataFrame, width: Column, key: tuple[str, ...] = PAGE) -> DataFrame:
    """MH-07: key, g0, g1 of the gutters between columns: empty runs of the projection, at least GUTTER_WIDTH points wide inside
    the middle GUTTER_ZONE of the page, with GUTTER_LINES lines or more to both sides."""
    lo, hi = ((F.col("width") * share).cast("int") for share in GUTTER_ZONE)
    empty = projection(lines, width, key).where("cover = 0").select(*key, F.greatest("x", lo).alias("g0"), F.least("until", hi).alias("g1"))
    wide = empty.where(F.col("g1") - F.col("g0") >= GUTTER_WIDTH)
    sides = wide.join(lines.select(*key, "x0", "x1"), list(key)).groupBy(*key, "g0", "g1")
    left, right = F.count_if(F.col("x1") <= F.col("g0") + GUTTER_SLACK), F.count_if(F.col("x0") >= F.col("g1") - GUTTER_SLACK)
    return sides.agg(left.alias("_l"), right.alias("_r")).where((F.col("_l") >= GUTTER_LINES) & (F.col("_r") >= GUTTER_LINES)).select(*key, "g0", "g1")


def reading_order(items: DataFrame, gutters: DataFrame, width: Column, key: tuple[str, ...] = PAGE) -> DataFrame:
    """WN-20, SL-10: ``items`` (item_id, box) with band, col and position in reading order, from :func:`column_gutters`.

    Items wider than SPANNING of the page or lying across the middle of a gutter span it; each ends the band of what starts
    above it. A band is read column by column, a column from the top. A page without gutters is read from the top.
    """
    mids = gutters.groupBy(*key).agg(F.sort_array(F.collect_list((F.col("g0") + F.col("g1")) / 2)).alias("_mids"))
    known = items.join(mids, list(key), "left").withColumn("_mids", F.coalesce("_mids", F.array().cast("array<double>")))
    across = F.exists("_mids", lambda m: (F.col("x0") < m) & (m < F.col("x1")))
    spans = (F.size("_mids") > 0) & ((F.col("x1") - F.col("x0") > width * SPANNING) | across)
    flagged = known.withColumn("_span", F.when(spans, 1).otherwise(0))
    page = Window.partitionBy(*key)
    # What starts level with a spanning item comes after it; spanning items come one after another.
    above = F.sum("_span").over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, 0))
    before = F.sum("_span").over(page.orderBy("y0", "item_id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    banded = flagged.withColumn("band", F.when(F.col("_span") == 1, before).otherwise(above).cast("long"))
    middle = (F.col("x0") + F.col("x1")) / 2
    col = F.when(F.col("_span") == 1, 0).otherwise(F.size(F.filter("_mids", lambda m: m < middle)))
    placed = banded.withColumn("col", col)
    order = page.orderBy("band", "_span", "col", "y0", "item_id")
    return placed.withColumn("position", F.row_number().over(order).cast("long") - 1).drop("_mids", "_span")


def paragraphs(items: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """WN-19: key, paragraph, text from items in ``position`` order (kind: line, table or code; text; size).

    A state machine over typed lines, as runs: tables, code and headings (marked, or set in HEADING_SIZE and more) stand alone,
    blank lines end a paragraph, other lines go on, and a word broken by a hyphen is joined.
    """
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("kind") == "line", T.strip(text)).otherwise(text)
    typed = items.select(*key, "position", "kind", body.alias("text"), F.coalesce("size", F.lit(10.0)).alias("size"))
    blank = (F.col("kind") == "line") & (F.col("text") == "")
    alone = (F.col("kind") != "line") | F.col("text").rlike(r"^#{1,6}\s+") | (F.col("size") >= HEADING_SIZE)
    down = Window.partitionBy(*key).orderBy("position")
    stops = typed.withColumns({"_blank": blank, "_stop": blank | alone})
    begins = F.col("_stop") | F.lag("_stop", 1, True).over(down)
    runs = stops.withColumn("_begins", begins.cast("int")).withColumn("paragraph", F.sum("_begins").over(down)).where(~F.col("_blank"))

    def go_on(done: Column, t: Column) -> Column:
        broken = done.rlike(r"\p{L}-\z") & t.rlike(r"\A\p{L}")
        return F.when(broken, F.concat(F.substr(done, F.lit(1), F.length(done) - 1), t)).otherwise(F.concat(done, F.lit(" "), t))

    listed = runs.groupBy(*key, "paragraph").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("t"))
    joined = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.col("t")[0], go_on)
    return listed.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("paragraph")).alias("paragraph"), joined.alias("text"))


_BOX = ("x0", "y0", "x1", "y1")


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.transform(F.array(value), use)[0]


def _box(*ends: Column) -> Column:
    return F.struct(*[e.cast("double").alias(c) for e, c in zip(ends, _BOX, strict=True)])


def _area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def free_of_masks(rect: Column, core: Column, masks: Column) -> Column:
    """MH-06: ``rect`` cut back until it meets no mask (array of boxes), null if that can't be.

    Each pass takes the boundary of all masks that overlap the box; of the four bands above, below, left and right of it, the
    largest that is no sliver (TRIM_SIDE) and holds the middle of ``core`` is what remains. A core whose middle is masked, a
    box that loses more than TRIM_SHARE allows, or one that isn't free after TRIM_PASSES looks is dropped.
    """
    mid_x, mid_y = (core["x0"] + core["x1"]) / 2, (core["y0"] + core["y1"]) / 2
    holds = lambda b: (b["x0"] <= mid_x) & (mid_x < b["x1"]) & (b["y0"] <= mid_y) & (mid_y < b["y1"])
    meets = lambda a, b: (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"]))
    going, free, dropped = F.lit(0), F.lit(1), F.lit(2)
    state = lambda r, s: F.struct(r.alias("r"), s.alias("s"))

    def cut(r: Column, hits: Column) -> Column:
        end = lambda c, pick: pick(F.transform(hits, lambda m: m[c]))
        blocked = _box(end("x0", F.array_min), end("y0", F.array_min), end("x1", F.array_max), end("y1", F.array_max))

        def of_bands(b: Column) -> Column:
            bands = F.array(_box(r["x0"], r["y0"], r["x1"], b["y0"]), _box(r["x0"], b["y1"], r["x1"], r["y1"]), _box(r["x0"], r["y0"], b["x0"], r["y1"]), _box(b["x1"], r["y0"], r["x1"], r["y1"]))
            kept = F.filter(bands, lambda x: (x["x1"] - x["x0"] >= TRIM_SIDE) & (x["y1"] - x["y0"] >= TRIM_SIDE) & holds(x))
            largest = F.aggregate(kept, F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"), lambda best, x: F.when(best.isNull() | (_area(x) > _area(best)), x).otherwise(best))
            sound = lambda x: x.isNotNull() & (_area(x) >= _area(r) * TRIM_SHARE) & (_area(x) >= F.greatest(_area(core), F.lit(1.0)) * TRIM_SHARE)
            return _let(largest, lambda x: F.when(~holds(b) & F.coalesce(sound(x), F.lit(False)), state(x, going)).otherwise(state(r, dropped)))

        return _let(blocked, of_bands)

    def look(acc: Column, _: Column) -> Column:
        hits = F.filter(masks, lambda m: meets(acc["r"], m))
        return F.when(acc["s"] != going, acc).otherwise(_let(hits, lambda h: F.when(F.size(h) == 0, state(acc["r"], free)).otherwise(cut(acc["r"], h))))

    start = state(_box(*[rect[c] for c in _BOX]), going)
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(TRIM_PASSES)), start, look), lambda a: F.when(a["s"] == free, a["r"]))


def _captions(tables: list[dict], blocks: list[dict]) -> list[dict]:
    """The caption of each table of one page; tables take theirs in order, a block serves once."""
    blocks = sorted(blocks, key=lambda b: (b["y0"], b["x0"], b["text"]))
    titled = [re.search(_CAPTION, b["text"]) is not None for b in blocks]
    used: set[int] = set()
    out = []
    for t in sorted(tables, key=lambda t: t["table_id"]):
        near = []
        for i, b in enumerate(blocks):
            beside = b["x1"] <= t["x0"] + CAPTION_LEFT and abs(b["y0"] - t["y0"]) <= CAPTION_TOP
            above = b["y1"] <= t["y0"] + CAPTION_UNDER and b["y0"] >= t["y0"] - CAPTION_ABOVE and b["x1"] >= t["x0"] and b["x0"] <= t["x1"]
            if titled[i] and i not in used and (beside or above):
                near.append((abs(b["y0"] - t["y0"]), i))
        words: list[str] = []
        if near:
            first, at = min(near)[1], None
            for i in range(first, len(blocks)):
                b = blocks[i]
                far = at is not None and b["y0"] - at > CAPTION_GAP
                if i in used or (titled[i] and i > first) or (b["x1"] > t["x0"] + CAPTION_LEFT and b["y0"] > t["y0"]) or b["y0"] > t["y1"] + CAPTION_BELOW or far:
                    break
                used.add(i)
                words += b["text"].split()
                at = b["y1"]
        out.append({"table_id": t["table_id"], "caption": " ".join(words) or None})
    return out


def nearest_captions(tables: DataFrame, blocks: DataFrame, height: float = 842.0, key: tuple[str, ...] = PAGE) -> DataFrame:
    """JN-17: key, table_id, caption of each table: of the caption-like blocks left of it or above it the one at the least
    vertical distance, with the blocks that continue it. Blocks in the page's margins don't count. A fold over one page, which
    is small; many pages make one Arrow batch."""

    @F.pandas_udf("array<struct<table_id:long,caption:string>>")
    def bind(found: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_captions(list(t), [] if b is None else list(b)) for t, b in zip(found, texts, strict=True)])

    listed = tables.groupBy(*key).agg(F.collect_list(F.struct("table_id", *_BOX)).alias("t"))
    inner = blocks.where((F.col("y0") > HEADER_END) & (F.col("y1") < height - FOOTER) & (T.strip(F.col("text")) != ""))
    listed_blocks = inner.groupBy(*key).agg(F.collect_list(F.struct("text", *_BOX)).alias("b"))
    return listed.join(listed_blocks, list(key), "left").select(*key, F.explode(bind("t", "b")).alias("x")).select(*key, "x.*")


def printed_contents(lines: DataFrame, first_pages: int = 25) -> DataFrame:
    """STR-23: title, page_no of printed table-of-contents lines (dot leaders and a number) on the first pages."""
    m = r"^\s*(\S.*?)\s*(?:\.\s*){3,}(\d{1,4})\s*$"
    found = lines.where((F.col("page") < first_pages) & F.col("text").rlike(m))
    return found.select("doc_id", "page", F.regexp_extract("text", m, 1).alias("title"), F.regexp_extract("text", m, 2).cast("int").alias("page_no"))


def table_markdown(rows: Column) -> Column:
    """STR-15: a table (array of arrays of strings) as Markdown; columns without a value go, a blank header takes its left
    neighbour's name; line ends and bars inside cells don't break the table."""
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "), r"\|", r"\\|"))
    clean = F.transform(rows, lambda r: F.transform(r, cell))
    width = F.aggregate(clean, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))
    at = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    used = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(clean, lambda r: at(r, i) != ""))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.transform(used, lambda i: at(F.get(clean, F.lit(0)), i))
    named = F.transform(head, lambda h, i: F.when(h != "", h).otherwise(F.coalesce(F.get(head, i - 1), F.lit(""))))
    body = F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), lambda r: line(F.transform(used, lambda i: at(r, i))))
    text = F.array_join(F.concat(F.array(line(named), line(F.transform(used, lambda i: F.lit("---")))), body), "\n")
    return F.when((F.size(rows) > 0) & (width > 0) & (F.size(used) > 0), text).otherwise("")
