"""Source code repositories: which files count, why others don't, and the units in Python files (SRC-08..10, UD-13, CP-10)."""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from millrace.operators.lines import byte_coverage
from millrace.operators.ranking import with_position
from millrace.session import written

#: Bytes of text that one part of a repository's order holds, and repositories up to which their first positions are broadcast.
PART_BYTES, BROADCAST_REPOSITORIES = 16 << 20, 500_000

# Folders and extensions that hold no source text.
IGNORED_DIRS = ".git .venv venv __pycache__ .pytest_cache .antigravity node_modules .idea .vscode dist build .egg-info qdrant_db".split()
IGNORED_EXTENSIONS = (
    ".pyc .pyo .pyd .so .dll .dylib .exe .bin .tar .gz .zip .7z .png .jpg .jpeg .gif .ico .svg .pdf .db .sqlite .sqlite3 .pkl .feather .parquet .onnx .pt .safetensors "
    ".gguf .mlmodel .wav .mp3 .mp4 .webm .ogg .flac .woff .woff2 .ttf .otf .wasm .jar .war .o .a .so.1 .lib .obj .npy .npz .h5 .ckpt .msgpack .arrow .orc .lance .ggml .idx"
).split()
SNIFFED = 8192
UNITS = "array<struct<unit_type:string,name:string,signature:string,docstring:string,code:string,line_count:int,lineno:int,sha1:string,byte_offset:long,end_offset:long>>"


def ignored_extension(path: Column) -> Column:
    """FLT-08: by the end of the file name."""
    return F.lower(path).rlike("(?:" + "|".join(map(re.escape, IGNORED_EXTENSIONS)) + r")\z")


def in_ignored_dir(path: Column) -> Column:
    """FLT-11: below an ignored or hidden folder, or a hidden file."""
    return path.rlike(r"(?:\A|/)(?:\.[^/]+|" + "|".join(map(re.escape, IGNORED_DIRS)) + r")(?:/|\z)") & ~path.rlike(r"\A\.gitignore\z")


@F.pandas_udf(BooleanType())
def looks_binary(content: pd.Series) -> pd.Series:
    """FLT-07: over 1 % NUL bytes or over 30 % undecodable characters in the first 8192 bytes."""

    def of(data: bytes | None) -> bool:
        head = (data or b"")[:SNIFFED]
        text = head.decode("utf-8", "replace")
        return bool(head) and (head.count(0) > 0.01 * len(head) or text.count("�") > 0.3 * len(text))

    return content.map(of)


def ignore_pattern(rule: str) -> tuple[str, bool]:
    """FLT-10: a rule of an ignore file as a regular expression over paths, and whether it takes files back in."""
    back = rule.startswith("!")
    rule = rule.lstrip("!").rstrip()
    anchored, only_dir = "/" in rule.rstrip("/"), rule.endswith("/")
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", rule.strip("/"))
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
    return (r"\A" if anchored else r"(?:\A|/)") + body + ("/" if only_dir else r"(?:/|\z)"), back


def gitignored(path: Column, rules: list[str]) -> Column:
    """FLT-10: whether the last rule that matches ignores the path."""
    out = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern, back = ignore_pattern(rule.strip())
            out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def with_reason(files: DataFrame, include: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """SRC-08, FLT-09, FLT-40: ``files`` (path, content) with reason: the first that holds, null for files to be read."""
    allowed = [e if e.startswith(".") else f".{e}" for e in (x.strip().lower() for x in include or []) if e]
    tests = [(F.lit(bool(allowed)) & ~F.lower("path").rlike("(?:" + "|".join(map(re.escape, allowed or ["."])) + r")\z"), "include_ext"), (in_ignored_dir(F.col("path")), "exclude"), (gitignored(F.col("path"), rules or []), "gitignore")]
    tests += [(ignored_extension(F.col("path")), "ext"), (looks_binary("content"), "sniff"), (F.col("content").isNull(), "unreadable")]
    return files.withColumn("reason", F.coalesce(*[F.when(t, name) for t, name in tests]))


def normalized(content: Column) -> Column:
    """SRC-10: text of bytes: without BOM, with \\n as line end, undecodable bytes replaced."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\\A\ufeff", "")
    return F.regexp_replace(text, r"\r\n?", "\n")


def python_units(source: str | None) -> list[dict]:
    """FLT-15: functions and classes of two lines at least, loops of three."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = (source or "").split("\n")
    offsets = [0]
    for x in lines:
        offsets.append(offsets[-1] + len(x.encode()) + 1)
    out = []
    for node in ast.walk(tree):
        kind = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop"}.get(type(node))
        if kind is None or node.end_lineno - node.lineno + 1 < (3 if kind == "loop" else 2):
            continue
        code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        name = getattr(node, "name", f"loop_L{node.lineno}")
        doc = ast.get_docstring(node) if kind != "loop" else None
        out.append(
            {"unit_type": kind, "name": name, "signature": lines[node.lineno - 1].strip()[:240], "docstring": doc or "", "code": code, "line_count": node.end_lineno - node.lineno + 1, "lineno": node.lineno}
            | {"sha1": hashlib.sha1(code.encode()).hexdigest(), "byte_offset": offsets[node.lineno - 1], "end_offset": offsets[node.lineno - 1] + len(code.encode())}
        )
    return sorted(out, key=lambda u: (u["lineno"], u["unit_type"], u["name"]))


def extract_units(files: DataFrame, text: str = "text") -> DataFrame:
    """path and the columns of UNITS for Python files."""

    @F.pandas_udf(UNITS)
    def units(texts: pd.Series) -> pd.Series:
        return texts.map(python_units)

    return files.where(F.lower("path").endswith(".py")).select("path", F.explode(units(text)).alias("u")).select("path", "u.*")


def unit_coverage(units: DataFrame, files: DataFrame) -> DataFrame:
    """AG-08 over units (path, byte_offset, end_offset) and files (path, size)."""
    spans = units.select("path", F.col("byte_offset").alias("start"), (F.col("end_offset") - 1).alias("stop"))
    return byte_coverage(spans, files, "path")


def coverage(files: DataFrame) -> DataFrame:
    """AG-06: by reason, by extension and in all: files and bytes, from one pass with grouping sets."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    rows = files.select(F.coalesce("reason", F.lit("kept")).alias("reason"), ext.alias("ext"), F.octet_length("content").cast("long").alias("size"))
    sets = rows.groupingSets([["reason"], ["ext"], []], "reason", "ext")
    return sets.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def repository_parts(files: DataFrame, repo: str) -> DataFrame:
    """SNK-07, AG-17: repo, position (from 0), text: the files of each repository as the parts of one Markdown text, in the
    order of paths. A repository of any size is many rows in order; a sink that writes them in that order has the whole text."""
    part = F.concat(F.lit("## "), F.col("path"), F.lit("\n\n```\n"), F.col("text"), F.lit("\n```\n"))
    size = files.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("n")).first().n or 0
    placed = with_position(files.select(repo, "path", part.alias("text")), repo, "path", name="_at", parts=-(-size // PART_BYTES))
    # Texts aren't dealt by their repository, of which there may be few: its first position is put beside them.
    first = written(placed.groupBy(F.col(repo).alias("_repo")).agg(F.min("_at").alias("_first")), "repositories")
    first = F.broadcast(first) if first.count() <= BROADCAST_REPOSITORIES else first
    return placed.join(first, F.col(repo).eqNullSafe(F.col("_repo"))).select(repo, (F.col("_at") - F.col("_first")).alias("position"), "text")


def repository_text(files: DataFrame, repo: str) -> DataFrame:
    """The parts of :func:`repository_parts` as one text a repository, for repositories that fit a row."""
    listed = F.sort_array(F.collect_list(F.struct("position", "text")))
    return repository_parts(files, repo).groupBy(repo).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))
