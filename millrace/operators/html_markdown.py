"""Markdown from HTML fragments (STR-01, STR-02) and question-and-answer pages (STR-03, STR-04, CP-09).

A fragment is read once, tag by tag; a table says what an element puts before and after its content. Elements whose content
doesn't count are passed over up to their own end, however they are nested.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TAG_TOKEN = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
_LANGUAGE = re.compile(r"(?:lang-|language-)([\w\-+]+)")
_SPACES = re.compile(r"[^\S\n]+(?=\n)")
#: What elements put before and after their content; those of one mark have no end. Any other tag is a space.
ELEMENTS = {
    "h1": ("\n# ", "\n"), "h2": ("\n## ", "\n"), "h3": ("\n### ", "\n"), "h4": ("\n#### ", "\n"), "h5": ("\n#### ", "\n"), "h6": ("\n#### ", "\n"),
    "p": (" ", "\n\n"), "li": ("\n* ", " "), "blockquote": ("\n> ", "\n"), "br": ("\n", "\n"), "hr": ("\n---\n", "\n---\n"),
}
#: Elements without text of their own, in fragments and around a wiki's text, and class names of a wiki's page furniture.
SILENT = frozenset("script style svg form button noscript".split())
WIKI_SILENT = SILENT | frozenset("header footer nav".split())
# Class names of a wiki's navigation, references and notices.
WIKI_CLASSES = {"div": "mw-editsection reflist navbox noprint sidebar catlinks hatnote ambox".split(), "table": "navbox sidebar".split()}


class _Reader:
    """Collects Markdown; ``silent`` is the element that is being passed over, with the depth of its name."""

    def __init__(self, wiki: bool):
        self.wiki, self.out = wiki, []
        self.silent, self.depth = "", 0
        self.code: list[str] | None = None
        self.pre = self.math = 0
        self.language = ""

    def text(self, text: str) -> None:
        if not self.silent and text:
            (self.out if self.code is None else self.code).append(html.unescape(text))

    def _ignored(self, name: str, raw: str) -> bool:
        if name in (WIKI_SILENT if self.wiki else SILENT):
            return True
        return self.wiki and name in WIKI_CLASSES and any(c in raw for c in WIKI_CLASSES[name])

    def _end_code(self) -> None:
        said = "".join(self.code or [])
        self.out.append(f"\n```{self.language}\n{said.strip()}\n```\n" if self.pre else f"`{said}`")
        self.code, self.pre, self.language = None, 0, ""

    def tag(self, closing: bool, name: str, raw: str) -> None:
        if self.silent:
            if name == self.silent:
                self.depth += -1 if closing else 1
                self.silent = self.silent if self.depth else ""
        elif self.code is not None:  # tags inside code go without a trace
            if name == "code" and not closing and self.pre:
                found = _LANGUAGE.search(raw)
                self.language = found[1] if found else ""
            elif closing and name == ("pre" if self.pre else "code"):
                self._end_code()
        elif not closing and self._ignored(name, raw) and not raw.endswith("/"):
            self.silent, self.depth = name, 1
            self.out.append(" ")
        elif not closing and name in ("pre", "code"):
            self.code, self.pre = [], int(name == "pre")
        elif name == "span" and (self.math or "math-container" in raw):
            self.out.append(" $" if not closing else "$ ")
            self.math += -1 if closing else 1
        else:
            self.out.append(ELEMENTS.get(name, (" ", " "))[closing])

    def read(self, page: str) -> str:
        at = 0
        for m in _TAG_TOKEN.finditer(page):
            self.text(page[at : m.start()])
            at = m.end()
            if m[2]:
                self.tag(bool(m[1]), m[2].lower(), m[3])
        self.text(page[at:])
        if self.code is not None:
            self._end_code()
        lines = _SPACES.sub("", "".join(self.out))
        return re.sub(r"\n{3,}", "\n\n", lines).strip()


#: Pages whose texts a worker holds as Python strings at once.
HELD = 64


def _converter(wiki: bool):
    @F.arrow_udf(StringType())
    def convert(pages: pa.Array) -> pa.Array:
        parts = (pages.slice(i, HELD).to_pylist() for i in range(0, len(pages), HELD))
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([_Reader(wiki).read(p or "") for p in part], pa.string()) for part in parts)])

    return convert


def markdown(c: Column) -> Column:
    """STR-01: Markdown of an HTML fragment; null and blank are empty."""
    return _converter(False)(c)


def wiki_markdown(c: Column, title: Column) -> Column:
    """STR-02: without a wiki's navigation; the title goes first unless a heading already does."""
    text = _converter(True)(c)
    return F.when((F.coalesce(title, F.lit("")) != "") & ~text.startswith("#") & (text != ""), F.concat(F.lit("# "), title, F.lit("\n\n"), text)).otherwise(text)


# The markup of question-and-answer pages.
_TITLE = r"""(?is)<h1[^>]*id=["']question-header["'][^>]*>(.*?)</h1>"""
_TAG = r"""(?is)<a[^>]*class=["'][^"']*post-tag[^"']*["'][^>]*>(.*?)</a>"""
_ANSWER = r"""(?is)<div[^>]*id=["']answer-\d+["'].*?(?=<div[^>]*id=["']answer-\d+["']|\z)"""
_QUESTION = r"""(?is)<div[^>]*id=["']question["'].*?(?=<div[^>]*id=["']answer-\d+["']|\z)"""
_BODY = r"""(?is)<div[^>]*class=["'][^"']*(?:post-text|s-prose)[^"']*["'][^>]*>(.*?)</div>"""
_SCORE = r"""(?i)data-score=["'](-?\d+)["']"""


def question_pages(pages: DataFrame, page: str = "html") -> DataFrame:
    """STR-03, CP-09: ``pages`` with title, tags, question_score, question_body and answers (accepted, score, body as HTML)."""
    tagless = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    score = lambda c: F.coalesce(F.regexp_extract(c, _SCORE, 1).try_cast("int"), F.lit(0))
    answers = F.transform(
        F.regexp_extract_all(page, F.lit(_ANSWER), F.lit(0)),
        lambda a: F.struct(F.regexp_extract(a, r"(?is)\A<div[^>]*>", 0).contains("accepted-answer").alias("accepted"), score(a).alias("score"), F.regexp_extract(a, _BODY, 1).alias("body")),
    )
    question = F.regexp_extract(page, _QUESTION, 0)
    return pages.withColumns(
        {
            "title": tagless(F.regexp_extract(page, _TITLE, 1)),
            "tags": F.transform(F.regexp_extract_all(page, F.lit(_TAG), F.lit(1)), tagless),
            "question_score": score(question),
            "question_body": F.regexp_extract(question, _BODY, 1),
            "answers": answers,
        }
    )


def thread_markdown(title: Column, tags: Column, score: Column, body: Column, answers: Column) -> Column:
    """STR-04: a thread as one Markdown text: title, tags, question, then the answers (accepted, score, body) as they are ranked."""
    head = F.concat(F.lit("# "), title, F.when(F.size(tags) > 0, F.concat(F.lit("\n\n**Tags:** "), F.array_join(tags, ", "))).otherwise(""))
    asked = F.concat(F.lit("## Question (score "), score.cast("string"), F.lit(")\n\n"), body)
    told = F.transform(answers, lambda a: F.concat(F.when(a["accepted"], "## Accepted answer (score ").otherwise("## Answer (score "), a["score"].cast("string"), F.lit(")\n\n"), a["body"]))
    return F.concat_ws("\n\n", head, asked, F.array_join(told, "\n\n"))
