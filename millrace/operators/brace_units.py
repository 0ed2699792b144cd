"""UD-14: units of brace languages (C, C++, CUDA, Metal, TypeScript) by a tolerant pushdown scan.

A file is cut into tokens (comments, strings, raw strings, directives, words, marks) and read once with a stack of open
brackets. What stands between the last boundary and an opening brace (the head) tells what the brace opens. Code that doesn't
close, closes too much or has halves in #if branches still gives the units that are whole; what is open at the end of the file
ends there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.code_units import UNITS

# The language of a file by its extension, and the least lines of a unit.
EXTENSIONS = {
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".h": "cpp", ".c": "cpp", ".ipp": "cpp", ".inl": "cpp", ".tcc": "cpp", ".cu": "cuda", ".cuh": "cuda", ".metal": "metal",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript",
}
LEAST_LINES = {"function": 2, "class": 2, "loop": 3, "namespace": 2, "macro": 1}
LOOPS = {"for": "for_loop", "while": "while_loop", "do": "do_while_loop"}
MODIFIERS = set("export default abstract declare public private protected static inline constexpr extern typedef friend virtual async override readonly function".split())
CLASSES = {"class", "struct", "union", "enum", "interface"}
# Words before parentheses that aren't the name of a function.
NO_NAMES = set("if switch catch else try return sizeof alignas alignof decltype noexcept throw requires new delete typeof await yield in of with __attribute__ __declspec __launch_bounds__".split()) | set(LOOPS)
ACCESS = {"public", "private", "protected", "signals", "slots"}

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<raw>R"(?P<d>[^()\\\s]{0,16})\(.*?(?:\)(?P=d)"|\Z))
      |(?P<directive>(?m:^)[ \t]*\#(?:\\\n|/\*.*?\*/|[^\n])*)
      |(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))
      |(?P<template>`(?:\\.|[^`\\])*(?:`|\Z))
      |(?P<word>[A-Za-z_$~][\w$]*)
      |(?P<number>\d[\w.']*)
      |(?P<mark>=>|::|->|[{}()\[\];,:=<>?&*!|+\-/%^.@\#\\])""",
    re.X | re.S,
)


class _Frame:
    """An open bracket: what it opens, where its unit begins, and the tokens of the head that grows inside it."""

    def __init__(self, mark: str, kind: str | None = None, name: str = "", start: int = 0, doc: str = ""):
        self.mark, self.kind, self.name, self.start, self.doc = mark, kind, name, start, doc
        self.head: list[tuple[str, int]] = []
        self.said = ""
        self.waiting: list[tuple[str, int]] = []  # loops without a brace: they end with the next statement

    def copy(self) -> _Frame:
        new = _Frame(self.mark, self.kind, self.name, self.start, self.doc)
        new.head, new.said, new.waiting = list(self.head), self.said, list(self.waiting)
        return new


def _without_template(words: list[str]) -> list[str]:
    """A head without its template parameters."""
    while words[:1] == ["template"]:
        depth, i = 0, 1
        while i < len(words):
            depth += (words[i] == "<") - (words[i] == ">")
            i += 1
            if not depth:
                break
        words = words[i:]
    return words


def _is_word(t: str) -> bool:
    return bool(re.match(r"[A-Za-z_$~]", t))


def classify(head: list[str]) -> tuple[str | None, str]:
    """(kind, name) of what a brace after the tokens of ``head`` opens; a closed pair of parentheses is one token "()"."""
    words = _without_template(head)
    while words and words[0] in MODIFIERS:
        words = words[1:]
    if not words:
        return None, ""
    first = words[0]
    if first in LOOPS:
        return "loop", LOOPS[first]
    if first in ("namespace", "module") and len(words) > 1 and "()" not in words:
        return "namespace", "".join(words[1:])
    if words[-1] == "=>":
        at = next((i for i, t in enumerate(words) if t in ("=", ":") and i), None)
        return "function", words[at - 1] if at and _is_word(words[at - 1]) else ""
    plain = next((i for i, t in enumerate(words) if t == "=" and words[i - 1] != "operator" and words[i - 2 : i - 1] != ["operator"]), None)
    if plain is not None:
        return None, ""
    # What follows the parameters: initialisers, a return type.
    cut = next((i for i, t in enumerate(words) if t == ":" and words[i - 1] in ("()", "noexcept", "const")), len(words))
    places = [i for i, t in enumerate(words[:cut]) if t == "()" and i and (_is_word(words[i - 1]) or "operator" in words[max(0, i - 3) : i]) and words[i - 1] not in NO_NAMES]
    tail = words[places[-1] + 1 : cut] if places else []
    if first not in NO_NAMES and first not in ("class", "interface") and places and (set(tail) & {"->"} or all(_is_word(t) or t in ("()", "&", "[", "]") for t in tail)) and not set(tail) & CLASSES:
        i = places[-1]
        if "operator" in words[max(0, i - 3) : i]:
            at = max(j for j in range(i) if words[j] == "operator")
            return "function", "".join(words[at:i])
        j = i - 1
        while j > 1 and words[j - 1] == "::" and _is_word(words[j - 2]):
            j -= 2
        return "function", "".join(words[j:i])
    at = next((i for i, t in enumerate(words) if t in CLASSES), None)
    if at is not None and first not in NO_NAMES:
        named = [t for t in words[at + 1 : next((i for i in range(at + 1, len(words)) if words[i] in (":", "extends", "implements", "<")), len(words))] if _is_word(t) and t not in CLASSES | NO_NAMES | {"final"}]
        return "class", named[-1] if named else ""
    return None, ""


def _cleaned(comment: str) -> str:
    """A comment without its marks, line by line."""
    lines = []
    for line in comment.split("\n"):
        line = re.sub(r"\s*\*/\s*$", "", re.sub(r"^\s*(?:/\*\*?|///?|\*(?!/)|#)\s?", "", line)).strip()
        if line:
            lines.append(line)
    return "\n".join(lines)


def scan(source: str, language: str = "cpp") -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first offset, last offset, comment before) of the units of a file; names may be empty."""
    out: list[tuple[str, str, int, int, str]] = []
    stack = [_Frame("")]
    branches: list[list[_Frame]] = []
    comment, comment_end = "", -1
    done_loop: tuple[str, int] | None = None

    def ended(frame: _Frame, end: int) -> None:
        """A statement of ``frame`` ends."""
        frame.head, frame.said = [], ""
        while frame.waiting:
            name, start = frame.waiting.pop()
            out.append(("loop", name, start, end, ""))

    for m in _TOKEN.finditer(source):
        kind, text, at, end = m.lastgroup if m.lastgroup != "d" else "raw", m.group(), m.start(), m.end()
        top = stack[-1]
        if kind == "comment":
            joined = comment and not source[comment_end:at].strip() and text.startswith("//") and comment.startswith("//")
            comment, comment_end = (comment + "\n" + text if joined else text), end
            continue
        if kind == "directive":
            if language == "typescript":
                continue
            word = re.match(r"\s*#\s*(\w+)\s*(\w*)", text)
            if word and word[1] == "define":
                out.append(("macro", word[2], at + len(text) - len(text.lstrip()), end, _cleaned(comment) if not source[comment_end:at].strip() and comment else ""))
            elif word and word[1] in ("if", "ifdef", "ifndef"):
                branches.append([f.copy() for f in stack])
            elif word and word[1] in ("else", "elif") and branches:
                # The other branch goes on from where the first one began.
                stack = [f.copy() for f in branches[-1]]
            elif word and word[1] == "endif" and branches:
                branches.pop()
            continue
        if kind == "mark" and text in "([":
            stack.append(_Frame(text))
        elif kind == "mark" and text in ")]":
            while len(stack) > 1 and stack[-1].mark in "([" and stack[-1].mark != {")": "(", "]": "["}[text]:
                stack.pop()
            if stack[-1].mark == {")": "(", "]": "["}[text]:
                stack.pop()
                outer = stack[-1]
                outer.head.append(("()" if text == ")" else "[]", at))
                words = [t for t, _ in outer.head]
                if text == ")" and len(words) in (2, 3) and words[0] in ("for", "while") and not re.compile(r"\s*(?://[^\n]*\n\s*|/\*.*?\*/\s*)*\{", re.S).match(source, end):
                    if words[0] == "while" and done_loop and done_loop[1] == id(outer):
                        pass  # the end of a do loop
                    else:
                        outer.waiting.append((LOOPS[words[0]], outer.head[0][1]))
                        outer.head = []
        elif text == "{" and kind == "mark":
            words = [t for t, _ in top.head]
            what, name = classify(words)
            start = top.head[0][1] if top.head else at
            stack.append(_Frame("{", what, name, start, top.said))
        elif text == "}" and kind == "mark":
            while len(stack) > 1 and stack[-1].mark in "([":
                stack.pop()
            if len(stack) > 1:
                frame = stack.pop()
                for name, start in frame.waiting:
                    out.append(("loop", name, start, at, ""))
                outer = stack[-1]
                if frame.kind == "loop" and frame.name == "do_while_loop":
                    done_loop = (f"{frame.start}", id(outer))
                    outer.head = []
                    continue
                if frame.kind:
                    out.append((frame.kind, frame.name, frame.start, end, frame.doc))
                elif any(t == "=" for t, _ in outer.head) or outer.mark in ("(", "["):
                    continue  # an initialiser or an argument: its statement goes on
                if not re.compile(r"\s*(?:else|catch|while)\b").match(source, end) or frame.kind:
                    ended(outer, end)
                else:
                    outer.head = []
        elif text in (";", ",") and kind == "mark" and top.mark in ("(", "["):
            top.head = []
        elif text == ";" and kind == "mark":
            if done_loop and done_loop[1] == id(top) and top.head and top.head[0][0] == "while":
                out.append(("loop", "do_while_loop", int(done_loop[0]), end, ""))
            done_loop = None
            ended(top, end)
        elif text == ":" and kind == "mark" and top.mark != "(" and top.head and top.head[0][0] in ACCESS | {"case", "default"}:
            top.head = []
        else:
            if not top.head:
                top.said = _cleaned(comment) if comment and not source[comment_end:at].strip() else ""
            top.head.append((text if kind in ("word", "mark") else '""', at))
    for frame in reversed(stack[1:]):
        if frame.kind and frame.mark == "{":
            out.append((frame.kind, frame.name, frame.start, len(source), frame.doc))
    return out


def brace_units(source: str | None, path: str, extended: bool = True) -> list[dict]:
    """FLT-15: the units of a file as rows of UNITS, whole lines each; namespaces and macros only if ``extended``."""
    source = source or ""
    language = EXTENSIONS.get(re.sub(r".*(?=\.)", "", path.lower(), flags=re.S))
    if language is None:
        return []
    lines = source.split("\n")
    starts, at = [0], 0
    for x in lines:
        at += len(x) + 1
        starts.append(at)
    sizes = [0]
    for x in lines:
        sizes.append(sizes[-1] + len(x.encode("utf-8", "surrogatepass")) + 1)
    out = []
    for kind, name, first, last, doc in scan(source, language):
        a, b = bisect_right(starts, first) - 1, bisect_right(starts, max(first, last - 1)) - 1
        if b - a + 1 < LEAST_LINES[kind] or (not extended and kind in ("namespace", "macro")):
            continue
        code = "\n".join(lines[a : b + 1])
        signature: list[str] = []
        for x in lines[a : min(b + 1, a + 3)]:
            signature.append(x.strip())
            if "{" in x or " ".join(signature).endswith((";", ")")):
                break
        label = f"{name}_L{a + 1}" if kind == "loop" else name or f"{kind}_L{a + 1}"
        out.append(
            {"unit_type": kind, "name": label, "signature": " ".join(signature)[:240], "docstring": doc, "code": code, "line_count": b - a + 1, "lineno": a + 1}
            | {"sha1": hashlib.sha1(code.encode("utf-8", "surrogatepass")).hexdigest(), "byte_offset": sizes[a], "end_offset": sizes[a] + len(code.encode("utf-8", "surrogatepass"))}
        )
    return sorted(out, key=lambda u: (u["lineno"], -u["line_count"], u["unit_type"], u["name"]))


def extract_brace_units(files: DataFrame, extended: bool = True, text: str = "text") -> DataFrame:
    """path and the columns of UNITS for files (path, text) of brace languages; other files give no rows."""

    @F.pandas_udf(UNITS)
    def units(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([brace_units(t, p, extended) for t, p in zip(texts, paths, strict=True)])

    known = F.lower("path").rlike("(?:" + "|".join(map(re.escape, EXTENSIONS)) + r")\z")
    return files.where(known).select("path", F.explode(units(text, "path")).alias("u")).select("path", "u.*")
