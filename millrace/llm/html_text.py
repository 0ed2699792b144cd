"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read as a sequence of text runs and tags. Words score positive, tags negative, and words of parts that are
boilerplate (menus, footers, sidebars, notices, adverts, forms, comments) negative too. One linear scan finds the contiguous
part of the greatest sum: the content region. Its blocks are the result, without the boilerplate parts inside it.

Weights come from labelled pages: pages that mark their article themselves with a single ``article`` or ``main`` element.
They are read as if the mark weren't there, so what is learned holds for pages without marks too. A block is prose if its
words outside of links are no fewer than those in links. Words in a prose block are plain words, whether linked or not; a
tag counts by the block that it opens, closes or stands in: tags of prose cost next to nothing, so links in running text
can't cut an article, and tags of blocks of links cost the log-odds of being met inside rather than outside of articles. On
pages with marks these are where content ends, so they cost most, and tags inside a mark cost nothing. A part is
boilerplate if its evidence is negative: what its tag, role and names say before anything is learned (a name counts only if
all of its parts are of that kind, so ``related-posts`` does and ``related-work`` doesn't), plus the learned log-odds of its
class and id names. A list of little but links is boilerplate outside of marked articles. No evidence holds against a part
that wraps the page's content: one with more than half of the words, and with a heading or article inside.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line ends.

Defined results: null, empty and textless pages have the empty text; unclosed tags end with the page, and unclosed
boilerplate parts at the next block; repeated rows are extracted alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages from which weights are learned, at most, and bytes of each at most (longer ones aren't learned from).
SAMPLE_PAGES, SAMPLE_PAGE_BYTES = 2000, 64 << 10
#: Part of the words that a wrapper holds, and part of a list's words in links that makes it a menu.
WRAPPER, MENU = 0.5, 0.8
#: Pages in which a class or id name must be met to be learned, and evidence below which a part is boilerplate.
NAME_PAGES, BOILERPLATE = 5, -1.0
#: What a tag costs at least, a tag of prose at most, and an inline tag of a block of links at most.
LEAST_COST, PROSE_COST, INLINE_COST = -0.02, -0.2, -0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML's elements without end tag, with raw text and of inline content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Elements that hold no article text, and names that pages give to such parts.
_NEVER = frozenset("head script style noscript template nav aside footer form button select option textarea svg canvas iframe object menu dialog audio video map title xmp noembed noframes".split())
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert sidebar sidebars rail widget widgets related recommended "
    "share sharing social newsletter subscribe subscription signup menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar popup modal overlay login search pagination pager copyright disclaimer skip".split()
)
# Elements of running text, which cost little before anything is learned.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tr td th figure figcaption hr".split()) | _INLINE
# Parts of names that go with such names and say nothing themselves.
_NEUTRAL = frozenset(
    "site page top bottom left right main global js box bar block list item items area panel section container wrapper wrap inner outer slot unit holder group button buttons link links icon icons form field post posts article articles content "
    "text title thread news story stories blog mobile desktop fixed sticky primary secondary module region nav header foot body".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_MARKS = ("article", "main")
_WHOLE = frozenset(["html", "body", "main"])


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _names(a: dict[str, str]) -> list[str]:
    """The class and id names of an element."""
    return f"{a.get('class', '')} {a.get('id', '')}".split()


def _says_boilerplate(name: str, of_article: bool) -> bool:
    """Whether all parts of a name belong to boilerplate, and one of them says so."""
    parts = {p.lower() for p in _NAME.findall(name)}
    said = parts & (frozenset({"comment", "comments", "reply", "ad", "advert"}) if of_article else _HINTS)
    return bool(said) and parts <= _HINTS | _NEUTRAL


def _evidence(name: str, raw: str, in_mark: bool, learned: dict[str, float]) -> float:
    """For (positive) or against an element being content; 0 without any."""
    if name in _NEVER or name == "header" and not in_mark:
        return -4.0
    if not raw or name in _WHOLE or raw.isspace():
        return 0.0
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("role", "").lower() in _ROLES:
        return -4.0
    names = _names(a)
    said = -3.0 if any(_says_boilerplate(n, name == "article") for n in names) else 0.0
    return said + sum(learned.get(n.lower(), 0.0) for n in names)


@dataclass
class Token:
    """A text run (name empty) or a tag; ``dead`` inside boilerplate, ``mark`` inside a marked article."""

    name: str
    text: str
    kind: str
    dead: bool
    mark: bool
    breaks: bool
    raw: str = ""
    linked: bool = False


def _read(page: str) -> list[tuple[str, bool, str, str]]:
    """(name, whether it closes, attributes, text) of the page's tags and text runs; raw text goes with its element."""
    out: list[tuple[str, bool, str, str]] = []
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            out.append(("", False, "", page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            out.append((name, False, "/", ""))
        else:
            out.append((name, closing, m[3], ""))
    if at < len(page):
        out.append(("", False, "", page[at:]))
    return out


def _extents(raw: list[tuple[str, bool, str, str]]) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """The closing tag of each closed element, and sums before each token: words, words in links, headings and articles."""
    end: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    words, linked, heads = [0], [0], [0]
    in_link = False
    for i, (name, closing, _, text) in enumerate(raw):
        n = len(text.split()) if not name else 0
        words.append(words[-1] + n)
        linked.append(linked[-1] + (n if in_link else 0))
        heads.append(heads[-1] + (name in ("h1", "h2", "article", "main", "p") and not closing))
        if name == "a":
            in_link = not closing
        if closing and opened.get(name):
            end[opened[name].pop()] = i
        elif name and not closing and name not in _VOID:
            opened.setdefault(name, []).append(i)
    return end, words, linked, heads


def _by_block(ts: list[Token]) -> list[Token]:
    """The tokens with kinds that tell tags of prose from tags of blocks of links: a block's own, those that open it, and
    those that close it."""
    prose: list[bool | None] = []  # of each token's block, None where it has no words
    start = 0
    for i in range(len(ts) + 1):
        if i < len(ts) and not ts[i].breaks:
            continue
        plain, linked = (sum(len(t.text.split()) for t in ts[start:i] if t.linked == x) for x in (False, True))
        prose += [plain >= linked if plain + linked else None] * (i - start)
        if i < len(ts):
            prose.append(None)
        start = i + 1
    after: list[bool | None] = [None] * (len(ts) + 1)
    for i in range(len(ts) - 1, -1, -1):
        after[i] = prose[i] if prose[i] is not None else after[i + 1]
    before: bool | None = None
    for i, t in enumerate(ts):
        before = prose[i] if prose[i] is not None else before
        if not t.name:
            t.kind = "word" if t.kind == "word:link" and prose[i] else t.kind
        elif (before if t.kind.startswith("/") and t.breaks else after[i] if t.breaks else prose[i]) is False:
            t.kind += ":links"
    return ts


def tokens(page: str, learned: dict[str, float] | None = None, unmarked: bool = False) -> list[Token]:
    """The page's text runs and tags; ``learned`` has the evidence of class and id names. ``unmarked``: as if the page had no
    article or main elements; tokens inside still carry the mark."""
    raw = _read(page)
    end, words, linked, heads = _extents(raw)
    strong = {i for i, (name, closing, _, _) in enumerate(raw) if name in (("h1",) if unmarked else ("h1", "article", "main")) and not closing}
    out: list[Token] = []
    marks = links = items = 0
    until = -1  # the closing tag of the boilerplate part that is open

    def inside(i: int, sums: list[int]) -> int:
        return sums[end[i]] - sums[i + 1] if i in end else 0

    def wraps(i: int, name: str) -> bool:
        if name in _NEVER and name != "form" or 2 * inside(i, words) <= 2 * WRAPPER * words[-1]:
            return False
        return inside(i, heads) > 0 if name == "form" else any(i < k < end[i] for k in strong)

    def menu(i: int, name: str) -> bool:
        n = inside(i, words)
        return name in ("ul", "ol", "menu", "dir") and (unmarked or not marks) and n >= 3 and inside(i, linked) >= MENU * n

    for i, (name, closing, attributes, text) in enumerate(raw):
        if not name:
            out.append(Token("", text, "word:link" if links else "word:item" if items else "word", i < until, bool(marks), False, linked=bool(links)))
            continue
        breaks = name not in _INLINE
        if unmarked and name in _MARKS and until < 0:
            marks = max(0, marks + (-1 if closing else 1))
            out.append(Token(name, "", "mark", False, bool(marks), breaks))
            continue
        if name in _RAW and attributes == "/":
            out.append(Token(name, "", name, True, bool(marks), breaks))
            continue
        if i == until:
            until = -1
            out.append(Token(name, "", f"/{name}", True, bool(marks), breaks))
            continue
        if until < 0 and not closing and name not in _VOID and not attributes.rstrip().endswith("/"):
            against = _evidence(name, attributes, bool(marks) and not unmarked, learned or {}) < BOILERPLATE
            if (against and not wraps(i, name)) or menu(i, name):
                until = end.get(i, -1)
                out.append(Token(name, "", name, True, bool(marks), breaks, attributes))
                continue
        if until < 0 and name in _MARKS:
            marks = max(0, marks + (-1 if closing else 1))
        if name == "a":
            links = 0 if closing else 1
        elif name in ("li", "td", "dd", "dt"):
            items = max(0, items + (-1 if closing else 1))
        out.append(Token(name, "", f"/{name}" if closing else name, until >= 0, bool(marks), breaks, "" if closing else attributes))
    return _by_block(out)


@dataclass
class Weights:
    """Scores of words (positive) and tags (negative)."""

    word: dict[str, float] = field(default_factory=lambda: {"word": 1.0, "word:item": 0.6, "word:link": 0.2})
    tag: dict[str, float] = field(default_factory=lambda: {f"{end}{n}": -0.05 for n in _RUNNING for end in ("", "/")})
    unknown_tag: float = -0.5
    link_tag: float = -1.0
    dead_word: float = -0.05
    dead_tag: float = -0.3
    mark: float = -60.0
    names: dict[str, float] = field(default_factory=dict)

    def of(self, t: Token) -> float:
        """A token's score. Boilerplate inside a marked article doesn't count: what follows it is still the article."""
        if t.kind == "mark" or (t.dead and t.mark):
            return 0.0
        if not t.name:
            n = len(t.text.split())
            return n * (self.dead_word if t.dead else self.word[t.kind])
        if t.dead:
            return self.dead_tag
        if t.name in _MARKS:
            return self.mark
        if t.mark:
            return 0.0
        of_links = t.kind.endswith(":links")
        return self.tag.get(t.kind, INLINE_COST if of_links and not t.breaks else self.link_tag if of_links else self.unknown_tag)


def learn(pages: list[list[Token]]) -> Weights:
    """Weights from the pages among ``pages`` (tokens of unmarked reading) that mark exactly one article."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    named: dict[bool, Counter] = {True: Counter(), False: Counter()}  # pages with a name inside and outside of their article
    for page in pages:
        if sum(t.kind == "mark" and t.mark for t in page) != 1:
            continue
        for where in (True, False):
            named[where].update({n.lower() for t in page if t.raw and t.mark == where for n in _names(_attributes(t.raw))})
        for t in page:
            if t.kind != "mark":
                (inside if t.mark and not t.dead else outside)[t.kind] += len(t.text.split()) if not t.name else 1
    weights = Weights()
    odds = lambda k: math.log((inside[k] + 1) / (outside[k] + 1))
    weights.word.update({k: min(1.5, max(0.1, odds(k))) for k in weights.word if inside[k] + outside[k] >= 20})
    weights.word["word"] = max(1.0, weights.word["word"])
    for k in {*inside, *outside} - {*weights.word}:
        if inside[k] + outside[k] >= 5:
            of_links, inline = k.endswith(":links"), k.removesuffix(":links").lstrip("/") in _INLINE
            most = 4.0 if of_links and not inline else INLINE_COST * -1 if of_links else PROSE_COST * -1
            weights.tag[k] = min(LEAST_COST, max(-most, odds(k)))
    for n in {*named[True], *named[False]}:
        if named[True][n] + named[False][n] >= NAME_PAGES:
            weights.names[n] = min(4.0, max(-4.0, math.log((named[True][n] + 0.5) / (named[False][n] + 0.5))))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous part with the greatest sum (the first of equals); empty if nothing is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str | None, weights: Weights, unmarked: bool = False) -> str:
    """The article text of a whole page; ``unmarked``: found without the page's own marks."""
    if not page:
        return ""
    ts = tokens(page, weights.names, unmarked)
    lo, hi = best_region([weights.of(t) for t in ts])
    while lo > 0 and lo < hi and not ts[lo - 1].breaks and not ts[lo - 1].dead:  # whole blocks only
        lo -= 1
    while 0 < hi < len(ts) and not ts[hi].breaks and not ts[hi].dead:
        hi += 1
    blocks: list[str] = []
    run: list[str] = []
    for t in [*ts[lo:hi], Token("", "", "", False, False, True)]:
        if t.breaks:
            block = " ".join("".join(run).split())
            if block:
                blocks.append(block)
            run = []
        elif t.name == "br":
            run.append(" ")
        elif not t.name and not t.dead:
            run.append(html.unescape(t.text))
    return "\n".join(blocks)


def train(pages: DataFrame) -> Weights:
    """Weights from a bounded sample of ``pages`` (page_id, html): one page of each of some ids, none longer than
    SAMPLE_PAGE_BYTES."""
    sized = pages.where((F.octet_length("html") <= SAMPLE_PAGE_BYTES) & F.col("page_id").isNotNull())
    ids = [r.page_id for r in sized.select("page_id").distinct().orderBy(F.xxhash64("page_id", F.lit(5)), "page_id").limit(SAMPLE_PAGES).collect()]
    if not ids:
        return Weights()
    some = sized.join(F.broadcast(pages.sparkSession.createDataFrame([(i,) for i in ids], "page_id long")), "page_id", "left_semi")
    return learn([tokens(r.html, unmarked=True) for r in some.groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").toLocalIterator()])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p, weights) for p in batch], dtype=object)

    found = pages.select("page_id", "url", text("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
