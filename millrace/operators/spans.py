"""Grounded spans: finding quotations in a text, heuristic entities, and highlighting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of technical entities with their class and whether case matters not; words that are no terms.
_PARTS = r"\b(ATmega\w+|ESP32\w*|STM32\w*|PIC\w*|MPU\d+|LM\d+|NE555|MAX\d+|RP2040|nRF\d+|BME\d+|ADS\d+|AD\d+)\b"
PRESETS = {
    "technical_components": [
        (_PARTS, "microcontroller_ic", True),
        (r"\b(\d+(?:\.\d+)?\s*(?:kΩ|MΩ|Ω|pF|nF|µF|uF|mF|V|mA|A|MHz|GHz|kHz))\b", "component_spec", True),
        (r"\b([A-Z]{2,}[0-9]*)\b", "technical_term", False),
    ],
    "general": [
        (r"\b(\d+(?:\.\d+)?\s*(?:kΩ|MΩ|Ω|pF|nF|µF|uF|mF|V|VAC|VDC|mA|A|MHz|GHz|kHz|Hz|W|mW|kW|dBm|dB))\b", "spec_value", True),
        (_PARTS, "component_ic", True),
        (r"\b([A-Z]{2,}[0-9]*|[A-Z][0-9]+[A-Z0-9]*)\b", "technical_term", False),
    ],
}
STOP_WORDS = frozenset(
    "THE AND FOR NOT ALL CAN USE HOW WHY WHAT FROM WITH WHEN WHERE THIS THAT THEN THESE THOSE EACH EVERY SOME ANY INTO OVER UNDER AFTER BEFORE WHICH WILL WOULD COULD SHOULD ALSO MORE MOST LESS ONLY VERY JUST ABOUT EVEN MADE MAKE".split()
)
SPANS = "array<struct<text_span:string,start_char:int,end_char:int,entity_type:string>>"


def entities(docs: DataFrame, key: str, text: str = "text", preset: str = "general") -> DataFrame:
    """UD-15's offline provider, STR-17, SET-04: key, text_span, start_char, end_char, entity_type; of a span the first class."""
    rules = [(re.compile(p, re.IGNORECASE if fold else 0), kind, fold) for p, kind, fold in PRESETS[preset]]

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[dict]:
            seen: dict = {}
            for rule, kind, fold in rules:
                for m in rule.finditer(t or ""):
                    if fold or m[0].strip().upper() not in STOP_WORDS:
                        seen.setdefault(m.span(), (m[0].strip(), kind))
            return [{"text_span": s, "start_char": a, "end_char": b, "entity_type": k} for (a, b), (s, k) in seen.items()]

        return pd.Series([of(t) for t in texts])

    return docs.select(key, F.explode(find(text)).alias("s")).select(key, "s.*")


def located(text: Column, quote: Column, start: Column | None = None) -> Column:
    """STR-16, WN-10: struct<start, stop> of a quotation (from 0): from ``start`` on, anywhere, in either case, with other white
    space; an untraceable one is (0, its length)."""
    q = F.regexp_replace(quote, r"(?U)^\s+|\s+\z", "")
    tries = [F.instr(text, q), F.instr(F.lower(text), F.lower(q))]
    if start is not None:
        tries.insert(0, F.nullif(F.instr(F.substring(text, start + 1, F.length(text)), q), F.lit(0)) + start)
    loose = F.concat(F.lit(r"(?is)("), F.regexp_replace(F.regexp_replace(q, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"(?U)\s+", r"\\s+"), F.lit(")"))
    match = F.regexp_substr(text, loose)
    at = F.coalesce(*[F.nullif(t, F.lit(0)) for t in tries])
    exact = F.struct((at - 1).alias("start"), (at - 1 + F.length(q)).alias("stop"))
    other = F.struct((F.instr(text, match) - 1).alias("start"), (F.instr(text, match) - 1 + F.length(match)).alias("stop"))
    return F.when(q == "", F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))).when(at.isNotNull(), exact).when(match.isNotNull(), other).otherwise(F.struct(F.lit(0).alias("start"), F.length(q).alias("stop")))


def located_in_order(text: Column, quotes: Column) -> Column:
    """WN-10, STR-16: array<struct<start, stop>> of an array of quotations: each is looked for from where the one before it was
    found, and only then in the whole text. One that isn't found, or is found at the very start, moves nothing."""
    kind = "struct<at:int,found:array<struct<start:int,stop:int>>>"

    def step(acc: Column, quote: Column) -> Column:
        here = F.transform(F.array(located(text, quote, acc["at"])), lambda x: F.struct(F.when(x["start"] > 0, x["start"]).otherwise(acc["at"]), F.concat(acc["found"], F.array(x))).cast(kind))
        return here[0]

    nothing = F.struct(F.lit(0), F.array().cast("array<struct<start:int,stop:int>>")).cast(kind)
    return F.aggregate(quotes, nothing, step, lambda acc: acc["found"])


def highlighted(text: Column, spans: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """STR-18, SNK-12: a text with its spans (start_char, end_char) marked, from the right so that positions stay; spans out of
    bounds are left out."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start_char"].cast("int").alias("a"), s["end_char"].cast("int").alias("b"))), asc=False)

    def add(t: Column, s: Column) -> Column:
        sound = (s["a"] >= 0) & (s["a"] < s["b"]) & (s["b"] <= F.length(t))
        return F.when(sound, F.concat(F.substring(t, F.lit(1), s["a"]), F.lit(before), F.substring(t, s["a"] + 1, s["b"] - s["a"]), F.lit(after), F.substring(t, s["b"] + 1, F.length(t)))).otherwise(t)

    return F.aggregate(ordered, text, add)


def with_titles(spans: DataFrame, articles: DataFrame) -> DataFrame:
    """JN-05: spans with document_title: the article's title, else its file name, else its number."""
    named = articles.select(F.col("id").alias("article_id"), F.coalesce(F.nullif("title", F.lit("")), F.nullif("filename", F.lit(""))).alias("document_title"))
    return spans.join(named, "article_id", "left").withColumn("document_title", F.coalesce("document_title", F.concat(F.lit("Article #"), F.col("article_id").cast("string"))))
