"""SRC-27, STR-23, PRJ-10, WN-16: books cut into chapters by their outline, else by headings of pages, else into slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import lines

# What opens a heading line of a scanned page.
HEADING = r"(?iu)^\s*(BÖLÜM|CHAPTER|KISIM|SECTION|PART|[0-9]+\.|[IVX|]+\.)\s+[A-ZÇĞİÖŞÜ0-9\s\-.:,]{3,80}"
HEAD_LINES, SCANNED_PAGES, TITLE_CHARS, SLICE_PAGES = 3, 200, 80, 15


def nested_titles(nodes: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """key, order, title, page, depth from outline nodes (key, order, title, depth, page): the title is led by those of the
    nodes above it, joined by " - ".

    A stack of open titles is folded over a book's nodes in ``order``: a node closes those at its depth or deeper and opens its
    own. A node whose page is unknown (null) isn't returned and titles nothing below it, which hangs under the node above it. A
    depth that skips levels hangs under the nearest node above it; a null depth counts as 0, a null title as empty. One book's
    outline is folded in one task; an empty table stays empty.
    """
    node = F.struct(F.col(order), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("depth").cast("int"), F.lit(0)).alias("depth"), F.col("page").cast("long").alias("page"))
    opened = "array<struct<depth:int,title:string>>"
    done = f"array<struct<{order}:{dict(nodes.dtypes)[order]},title:string,depth:int,page:bigint>>"

    def step(state, n):
        above = F.filter(state["open"], lambda o: o["depth"] < n["depth"])
        parent = F.when(F.size(above) > 0, F.element_at(above, -1)["title"]).otherwise(F.lit(""))
        title = F.when(parent != "", F.concat(parent, F.lit(" - "), n["title"])).otherwise(n["title"])
        known = n["page"].isNotNull()
        return F.struct(
            F.when(known, F.concat(above, F.array(F.struct(n["depth"].alias("depth"), title.alias("title"))))).otherwise(above).alias("open"),
            F.when(known, F.concat(state["done"], F.array(F.struct(n[order].alias(order), title.alias("title"), n["depth"].alias("depth"), n["page"].alias("page"))))).otherwise(state["done"]).alias("done"),
        )

    start = F.struct(F.array().cast(opened).alias("open"), F.array().cast(done).alias("done"))
    folded = nodes.groupBy(key).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return folded.select(key, F.inline(F.aggregate("nodes", start, step, lambda s: s["done"]))).select(key, order, "title", "page", "depth")


def page_headings(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, title, page, depth (0) of pages (key, page from 0, text) that begin with a heading: the first of a page's first
    three lines that aren't blank which looks like one, on a book's first 200 pages. A null text has no line.
    """
    said = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    found = F.filter(F.slice(said, 1, HEAD_LINES), lambda x: x.rlike(HEADING))
    seen = pages.where(F.col("page") < SCANNED_PAGES).select(key, F.col("page").cast("long").alias("page"), F.get(found, 0).alias("line"))
    return seen.where("line IS NOT NULL").select(key, F.substring("line", 1, TITLE_CHARS).alias("title"), "page", F.lit(0).alias("depth"))


def chapters(nodes: DataFrame, books: DataFrame, key: str = "doc_id", order: str = "pos", max_depth: int | None = None) -> DataFrame:
    """key, title, start, stop (last page) of the nodes (key, order, title, page, depth) of books (key, n_pages): up to the page
    before the next node, the last one up to the end of the book.

    Of nodes on one page the first stays. Nodes deeper than ``max_depth`` then cut nothing, what they name stays in the chapter
    around them; a book with none as shallow keeps all. Nodes beyond the last page are left out; pages before the first node
    are no chapter.
    """
    inside = nodes.join(books.select(key, "n_pages"), key).where("page >= 0 AND page < n_pages")
    first = inside.groupBy(key, "page").agg(F.min_by(F.struct(order, "title", "depth", "n_pages"), F.struct(order, "depth", "title")).alias("n")).select(key, "page", "n.*")
    if max_depth is not None:
        shallow = F.col("depth") <= max_depth
        any_shallow = F.max(shallow).over(Window.partitionBy(key))
        first = first.withColumn("_any", any_shallow).where(shallow | ~F.col("_any")).drop("_any")
    return lines.segments(first.withColumnRenamed(order, "node_no"), key)


def slices(books: DataFrame, key: str = "doc_id", size: int = SLICE_PAGES) -> DataFrame:
    """key, title, start, stop of books (key, n_pages) cut every ``size`` pages; a book without pages gives none."""
    starts = F.when(F.col("n_pages") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_pages").cast("long") - 1, F.lit(size).cast("long")))
    cut = books.select(key, "n_pages", F.explode(starts).alias("start"))
    return cut.select(key, F.concat(F.lit("Section starting page "), F.col("start") + 1).alias("title"), "start", F.least(F.col("start") + size, F.col("n_pages")).cast("long").alias("stop")).withColumn("stop", F.col("stop") - 1)


def book_segments(pages: DataFrame, outline: DataFrame, key: str = "doc_id", order: str = "pos", max_depth: int | None = None) -> DataFrame:
    """key, title, start, stop, found_by (outline, headings or slices) of books given by their pages (key, page from 0, text).

    Each book takes the first way that finds a node in it: its outline, headings of its pages, slices of 15 pages. Pages are
    numbered without gaps; repeated ones count once. An outline that finds no page of a book that exists counts as none.
    Pages of a null key are one book, which is cut into slices.
    """
    books = pages.groupBy(key).agg((F.max("page").cast("long") + 1).alias("n_pages"))
    titled = nested_titles(outline, key, order).join(books, key).where("page >= 0 AND page < n_pages").drop("n_pages")
    by_outline = chapters(titled, books, key, order, max_depth)
    rest = books.join(titled.select(key).distinct(), key, "left_anti")
    headed = page_headings(pages, key).join(rest.select(key), key, "left_semi")
    by_headings = chapters(headed.withColumn(order, F.col("page")), rest, key, order)
    by_slices = slices(rest.join(headed.select(key).distinct(), key, "left_anti"), key)
    named = lambda d, way: d.select(key, "title", "start", "stop", F.lit(way).alias("found_by"))
    return named(by_outline, "outline").unionByName(named(by_headings, "headings")).unionByName(named(by_slices, "slices"))
