"""Nested JSON kept in text columns: tolerant parsing with built-in variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT_KEYS = ("text", "question", "answer", "chosen", "rejected")


def items(c: Column) -> Column:
    """JS-01, JS-02: the objects of a JSON array; a bare object is an array of one, what doesn't parse is empty.

    Other elements of an array are left out one by one; they don't spoil their neighbours.
    """
    v = F.try_parse_json(c)
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.coalesce(F.filter(listed, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))), F.array().cast("array<variant>"))


def stringify(v: Column) -> Column:
    """PRJ-01: text of a value of any shape: an object's first text field, a list's elements joined by spaces, '' for null."""
    inner = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in _TEXT_KEYS], F.to_json(v))
    listed = F.try_variant_get(v, "$", "array<variant>")
    kind = F.schema_of_variant(v)
    text = (
        F.when(v.isNull() | (kind == "VOID"), "")
        .when(kind.startswith("OBJECT"), inner)
        .when(kind.startswith("ARRAY"), F.array_join(F.transform(listed, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))), " "))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")


def text_at(v: Column, *keys: str) -> Column:
    """The text of the first of an object's ``keys`` that isn't empty."""
    found = [stringify(F.try_variant_get(v, f"$.{k}", "variant")) for k in keys]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def question_answers(c: Column) -> Column:
    """array<struct<question, answer>> of a JSON text; pairs with an empty side are left out."""
    pairs = F.transform(items(c), lambda x: F.struct(text_at(x, "question").alias("question"), text_at(x, "answer").alias("answer")))
    return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))


def preferences(c: Column) -> Column:
    """array<struct<prompt, chosen, rejected>> of a JSON text; only pairs with all three."""
    pairs = F.transform(items(c), lambda x: F.struct(text_at(x, "prompt", "question").alias("prompt"), text_at(x, "chosen", "answer").alias("chosen"), text_at(x, "rejected").alias("rejected")))
    return F.filter(pairs, lambda p: (p["prompt"] != "") & (p["chosen"] != "") & (p["rejected"] != ""))


def messages(c: Column) -> Column:
    """FLT-27: array<struct<role, content>> if the text is a list of two turns at least that all have both; else null."""
    v = F.try_parse_json(c)
    turns = F.try_variant_get(v, "$", "array<struct<role:string,content:string>>")
    return F.when((F.size(turns) >= 2) & F.forall(turns, lambda t: t["role"].isNotNull() & t["content"].isNotNull()), turns)


def attributes(c: Column) -> Column:
    """JS-07: a map of strings, empty if the text doesn't parse."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def outer_object(c: Column) -> Column:
    """JS-10: from the first brace to the last."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def healed(c: Column) -> Column:
    """JS-03, the deterministic tiers: fences and reasoning off, trailing commas out, invalid escapes doubled, outer object."""
    out = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"```[a-zA-Z]*", "")
    out = F.regexp_replace(out, r",(\s*[}\]])", "$1")
    out = F.regexp_replace(out, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r"$1\\\\")
    tiers = [c, out, F.nullif(outer_object(out), F.lit(""))]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull(), t) for t in tiers])


def canonical(df_columns: list[str]) -> Column:
    """JS-04: one record as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(df_columns)))


def tag_list(tags: Column, default: str = "General") -> Column:
    """JS-09: tags joined by commas, a default where there are none."""
    return F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.array_join(tags, ", ")).otherwise(default)
