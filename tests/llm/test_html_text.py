"""Extraction on pages of several kinds, and the scan against all regions."""

import random
from html.parser import HTMLParser

import pytest

from millrace.llm import html_text

W = html_text.Weights()
P = "word " * 12
CASES = [
    (None, ""),
    ("", ""),
    ("<p></p>", ""),
    ("plain text only", "plain text only"),
    (f"<html><head><title>no</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1><p>{P}</p><p>End.</p></article><footer>&copy; site</footer></body>", f"Title\n{P.strip()}\nEnd."),
    (f"<body><div class='top-menu'>a b c d e</div><div id=content><h2>T &amp;amp; x</h2><p>{P}<b>bo</b>ld\n  x&nbsp;y</p></div><div class='comments'><p>{P}</p></div>", f"T &amp; x\n{P.strip()} bold x y"),
    (f"<main><p>{P}</p><aside>{P}</aside><div class='advert'>buy</div><form>name <input></form><p>more text here</p></main>", f"{P.strip()}\nmore text here"),
    (f"<article><p>{P}<p>second<script>var a = '</p>';</script><!-- x --><style>p{{}}</style></article><article class='comment'>{P}{P}</article>", f"{P.strip()}\nsecond"),
    (f"<div role=navigation>x y z</div><div class=cookieNotice>ok</div><p>{P}</p><ul><li>one<li>two</ul><table><tr><td>c</td></tr></table>", f"{P.strip()}\none\ntwo\nc"),
    # A form around the whole page, names that only look like boilerplate, menus and comment parts without known tags.
    (f"<body><form id=aspnetForm><ul><li><a href=x>Home page</a><li><a href=y>About us</a></ul><div><h1>Title</h1><p>{P}</p></div></form></body>", f"Title\n{P.strip()}"),
    (f"<div class='article related-work'><p>{P}</p></div><div class='related-posts'>{P}</div>", P.strip()),
    (f"<article><p>{P}</p><div class='search-results-explained'><p>{P}</p></div><div class=site-search>find it</div></article>", f"{P.strip()}\n{P.strip()}"),
    (f"<div id=postComments>one two</div><p>{P}</p><ul class=x7><li><a href=a>first link</a></li><li><a href=b>second link</a></li></ul>", P.strip()),
    (f"<div class=sidebar><h1>Site</h1></div><div class='page-wrap ads'><h1>T</h1><article><p>{P}</p></article></div>", P.strip()),
    (f"<article><p>{P}</p><nav>unclosed", P.strip() + "\nunclosed"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_pages(page, want):
    assert html_text.main_text(page, W) == want


@pytest.mark.parametrize("seed", range(5))
def test_scan_finds_the_greatest_sum(seed):
    rng = random.Random(seed)
    s = [rng.choice([-3.0, -1.0, -0.25, 0.5, 2.0]) for _ in range(40)]
    sums = {(i, j): sum(s[i:j]) for i in range(41) for j in range(i + 1, 41)}
    lo, hi = html_text.best_region(s)
    assert sum(s[lo:hi]) == max(0, *sums.values())
    assert html_text.best_region([-1.0, 0.0]) == (0, 0)


class Article(HTMLParser):
    """The blocks of a page's article, read by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.run = 0, [], []
        self.feed(page)
        self.close()

    def end(self):
        if "".join(self.run).split():
            self.blocks.append(" ".join("".join(self.run).split()))
        self.run = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.run.append(" ")
        elif tag not in html_text._INLINE:
            self.end()

    def handle_endtag(self, tag):
        if tag not in html_text._INLINE:
            self.end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.run.append(data)


def test_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").selectExpr("*", "1 AS text", "2 AS n_chars")
    weights = html_text.train(pages)
    assert all(v > 0 for v in weights.word.values()) and all(v < 0 for v in weights.tag.values()) and weights.names["ad"] < 0
    rows = {r.page_id: r for r in html_text.extract(pages, weights).collect()}
    for r in pages.collect():
        want = "\n".join(Article(r.html).blocks)
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)


@pytest.fixture(scope="module")
def learned(spark, small):
    return html_text.train(spark.read.parquet(f"{small}/pages.parquet"))


LINK = "<a href=x>linked</a>"


@pytest.mark.parametrize("mark", ["main", "article", "div"])
def test_links_in_prose_do_not_cut(learned, mark):
    """With weights learned from a table in which links stand in menus only."""
    short = "".join(f"<p>para {i} {LINK} and {LINK}</p>" for i in range(5))
    pages = [
        (f"<h1>The title</h1>{short}<p>{'word ' * 30}</p>", ["The title", *(f"para {i} linked and linked" for i in range(5)), ("word " * 30).strip()]),
        (f"<h1>A title</h1><p>By {LINK}</p><p>{'word ' * 30}</p><p>one {LINK} two {LINK} three {LINK}</p><p>{'end ' * 12}</p>", ["A title", "By linked", ("word " * 30).strip(), "one linked two linked three linked", ("end " * 12).strip()]),
        (f"<p>{'alpha ' * 20}</p><ul>{'<li>an item of a list with words</li>' * 12}</ul><p>{'omega ' * 15}</p>", [("alpha " * 20).strip(), *["an item of a list with words"] * 12, ("omega " * 15).strip()]),
    ]
    for body, want in pages:
        page = f"<body><nav><ul>{f'<li>{LINK}</li>' * 8}</ul></nav><{mark}>{body}</{mark}><footer>foot</footer></body>"
        assert html_text.main_text(page, learned).split("\n") == want
        assert html_text.main_text(page, W).split("\n") == want


def test_linked_items_inside_a_mark_stay(learned):
    page = f"<main><p>{'alpha ' * 20}</p><ul>{f'<li>{LINK}</li>' * 12}</ul><p>{'omega ' * 15}</p></main>"
    for weights in (W, learned):
        assert html_text.main_text(page, weights).split("\n") == [("alpha " * 20).strip(), *["linked"] * 12, ("omega " * 15).strip()]


def test_menus_without_marks_go(learned):
    """Blocks of links that no name or element gives away end the region."""
    menu = "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(12))
    page = f"<body><div>{menu}</div><div><h1>T</h1><p>{P}{P}</p><p>see {LINK} there</p><p>{P}</p></div><div>{menu}</div></body>"
    for weights in (W, learned):
        assert html_text.main_text(page, weights).split("\n") == ["T", (P + P).strip(), "see linked there", P.strip()]


def test_pages_without_their_marks(spark, small, learned):
    """What the scan finds without marks is what the marks say."""
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    same = [html_text.main_text(p, learned, unmarked=True) == "\n".join(Article(p).blocks) for p in pages]
    assert sum(same) >= 0.95 * len(same)


@pytest.mark.parametrize("seed", range(3))
def test_nothing_of_a_marked_article_is_lost(learned, seed):
    rng = random.Random(seed)

    def inline():
        return rng.choice(["word", "two words", LINK, f"<b>{LINK}</b>", "<em>x</em> y"])

    def block(depth=0):
        kind = rng.choice(["p", "h2", "div", "ul", "table", "blockquote"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if kind == "table":
            return "<table><tr>" + "".join(f"<td>{inline()}</td>" for _ in range(3)) + "</tr></table>"
        inner = block(depth + 1) if kind == "div" and depth < 3 else " ".join(inline() for _ in range(rng.randrange(1, 9)))
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(60):
        body = "".join(block() for _ in range(rng.randrange(1, 10)))
        page = f"<body><nav>{LINK * 5}</nav><div class=ad>buy</div><article>{body}</article><footer>f</footer></body>"
        for weights in (W, learned):
            assert html_text.main_text(page, weights) == "\n".join(Article(page).blocks)


def test_names_are_learned():
    page = f"<div class=zq><p>{P}</p></div><article><p>{P}</p><div class='sidebar'>kept {P}</div></article>"
    weights = html_text.learn([html_text.tokens(page, unmarked=True)] * 20)
    assert weights.names["zq"] < html_text.BOILERPLATE < 1 < weights.names["sidebar"]
    assert html_text.main_text(f"<div class=zq><p>{P}</p></div><div><p>{P}</p></div>", weights) == P.strip()
    assert html_text.main_text(page, weights).endswith(f"kept {P.strip()}")


def test_very_long_page():
    body = "".join(f"<p>{P}{i}</p>" for i in range(20000))
    got = html_text.main_text(f"<nav>menu</nav><div>{body}</div><footer>end</footer>", W).split("\n")
    assert len(got) == 20000 and got[-1] == f"{P}19999"


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "v", "<b>" * 3000 + "y")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract(df, html_text.train(df)).collect()) == ["", "", "x", "y"]
    assert html_text.extract(df.limit(0), html_text.train(df.limit(0))).collect() == []
