"""Upkeep of enriched documents: boilerplate, translations that fell back to English, judging and repair of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import json_fields as J
from millrace.functions.text import is_boilerplate, is_boilerplate_article, is_turkish, strip
from millrace.operators import export, judging


def unjudged(df: DataFrame) -> DataFrame:
    """FLT-23: rows without a verdict."""
    return df.where(F.coalesce("judge_status", F.lit("")) == "")


def positional_pairs(a: Column, b: Column) -> Column:
    """JN-14: the elements of two arrays side by side (a, b); the shorter one is filled with nulls."""
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def fell_back(source: Column, translated: Column) -> Column:
    """FLT-36: a translation (JSON pairs) that isn't one: it doesn't parse, has another number of pairs, repeats a question or
    holds a question without a word of Turkish."""
    ours, theirs = J.question_answers(source), J.question_answers(translated)
    same = lambda p: strip(F.lower(p["a"]["question"])) == strip(F.lower(p["b"]["question"]))
    odd = F.exists(positional_pairs(ours, theirs), lambda p: F.coalesce(same(p) | ~is_turkish(p["b"]["question"]), F.lit(True)))
    return (F.size(ours) != F.size(theirs)) | F.try_parse_json(translated).isNull() | odd


def reset_fallbacks(df: DataFrame, fields: tuple[str, ...] = ("tr_sft_qa", "tr_dpo_pairs", "turkish_summary")) -> DataFrame:
    """CP-15, DM-08: the translated fields of rows that fell back to English are emptied, so that they are translated again."""
    again = F.coalesce(fell_back(F.col("sft_qa"), F.col("tr_sft_qa")), F.lit(True)) & (strip(F.coalesce("tr_sft_qa", F.lit(""))) != "")
    return df.withColumn("was_reset", again).withColumns({f: F.when(F.col("was_reset"), "").otherwise(F.col(f)) for f in fields})


def cleaned(articles: DataFrame, enrichments: DataFrame) -> DataFrame:
    """DM-06, FLT-34: enrichments with is_excluded set for boilerplate articles, boilerplate pairs pruned from sft_qa, and the
    number of pruned pairs (n_pruned)."""
    titled = enrichments.join(articles.select(F.col("id").alias("article_id"), "title"), "article_id", "left")
    pairs = J.question_answers(F.col("sft_qa"))
    kept = F.filter(pairs, lambda p: ~is_boilerplate(p["question"]) & ~is_boilerplate(p["answer"]))
    flagged = is_boilerplate_article(F.col("title"), F.coalesce("summary", F.lit("")))
    out = titled.withColumns({"is_excluded": F.when(flagged, 1).otherwise(F.coalesce("is_excluded", F.lit(0))), "n_pruned": F.size(pairs) - F.size(kept), "sft_qa": F.to_json(kept)})
    return out.select(*enrichments.columns, "n_pruned")


def clean_and_export(articles: DataFrame, enrichments: DataFrame, dataset: str, language: str = "bilingual") -> dict[str, DataFrame]:
    """CP-02: boilerplate goes, then the sets are made anew."""
    return export.export_sets(articles, cleaned(articles, enrichments).drop("n_pruned"), dataset, language)


def judge_all(df: DataFrame, threshold: float = judging.APPROVED, editor: float = judging.EDITOR) -> DataFrame:
    """CP-07: rows with a verdict on their first pair (JS-11) where they had none; rows without a pair stay as they are."""
    pair = judging.priority_pair(*(F.col(c) for c in ("tr_dpo_pairs", "dpo_pairs", "tr_sft_qa", "sft_qa")))
    todo = unjudged(df).withColumn("_pair", pair).withColumns({"chosen": F.col("_pair.chosen"), "rejected": F.col("_pair.rejected")})
    scored = judging.judged(todo.where("_pair IS NOT NULL").drop("judge_score", "judge_status"), threshold, editor)
    fresh = scored.select("id", F.col("judge_score").cast("double").alias("_score"), F.col("judge_status").alias("_status"))
    return df.join(fresh, "id", "left").withColumns({"judge_score": F.coalesce("_score", "judge_score"), "judge_status": F.coalesce("_status", "judge_status")}).drop("_score", "_status")


def batch_results(rows: DataFrame, results: DataFrame, prefix: str = "enrichment_") -> DataFrame:
    """JN-11: results (custom_id, body) beside the rows (id) that their custom id names; ids of another form are left out."""
    named = results.withColumn("id", F.regexp_extract("custom_id", rf"^{prefix}(\d+)$", 1).try_cast("long")).where("id IS NOT NULL")
    return rows.join(named.select("id", "body"), "id")


def copy_when_empty(df: DataFrame, target: str, source: str, empty: tuple[str, ...] = ("", "[]", "null")) -> DataFrame:
    """DM-03, DM-09: ``target`` takes the value of ``source`` where it is null or empty."""
    return df.withColumn(target, F.when(F.trim(F.coalesce(target, F.lit(""))).isin(*empty), F.col(source)).otherwise(F.col(target)))


def translated_pairs(reply: Column, source: Column) -> Column:
    """STR-22: the pairs of a reply in the form ``Title: … Q1: … A1: … Q2: …``: for each pair of ``source`` (question, answer)
    what the reply has under its number, or else the source's own text."""

    def said(mark: str, i: Column) -> Column:
        found = F.regexp_substr(reply, F.concat(F.lit(rf"(?s)(?:(?<=\A)|(?<=\n)){mark}"), i.cast("string"), F.lit(r":.*?(?=\n(?:[QA]\d+|Title|Summary|DPO_\w+):|\z)")))
        return F.nullif(strip(F.regexp_replace(found, rf"(?s)\A{mark}\d+:", "")), F.lit(""))

    return F.transform(source, lambda p, i: F.struct(F.coalesce(said("Q", i + 1), p["question"]).alias("question"), F.coalesce(said("A", i + 1), p["answer"]).alias("answer")))
