"""Judging answer pairs: where a pair comes from, the offline verdict, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import json_fields as J
from millrace.functions.text import strip

APPROVED, EDITOR = 7.0, 5.5
COUNTED = ("approved", "borderline", "rejected")


def priority_pair(tr_dpo: Column, dpo: Column, tr_sft: Column, sft: Column) -> Column:
    """JS-11: struct<source, prompt, chosen, rejected> of the first source with a pair, or null."""

    def preference(c: Column, name: str) -> Column:
        x = F.try_element_at(J.items(c), F.lit(1))
        pair = F.struct(F.lit(name).alias("source"), J.text_at(x, "prompt", "question").alias("prompt"), J.text_at(x, "chosen", "answer").alias("chosen"), J.text_at(x, "rejected").alias("rejected"))
        return F.when(F.size(J.items(c)) > 0, pair)

    def answer(c: Column, name: str) -> Column:
        x = F.try_element_at(J.items(c), F.lit(1))
        pair = F.struct(F.lit(name).alias("source"), J.text_at(x, "question").alias("prompt"), J.text_at(x, "answer").alias("chosen"), F.lit("").alias("rejected"))
        return F.when(F.size(J.items(c)) > 0, pair)

    return F.coalesce(preference(tr_dpo, "tr_dpo"), preference(dpo, "dpo"), answer(tr_sft, "tr_sft"), answer(sft, "sft"))


def status_of(score: Column, threshold: float = APPROVED, editor: float = EDITOR) -> Column:
    """UD-07: approved, borderline or rejected by a score."""
    return F.when(score >= threshold, "approved").when(score >= editor, "borderline").otherwise("rejected")


def offline_score(chosen: Column, rejected: Column) -> Column:
    """UD-08: 3.0 for an answer under 15 characters or equal to the rejected one, else 7.5."""
    c, r = strip(F.coalesce(chosen, F.lit(""))), strip(F.coalesce(rejected, F.lit("")))
    return F.when((F.length(c) < 15) | ((r != "") & (F.lower(c) == F.lower(r))), 3.0).otherwise(7.5)


def judged(pairs: DataFrame, threshold: float = APPROVED, editor: float = EDITOR) -> DataFrame:
    """``pairs`` (chosen, rejected, ...) with judge_score and judge_status. A low score is rejected whatever the threshold."""
    scored = pairs.withColumn("judge_score", offline_score(F.col("chosen"), F.col("rejected")))
    return scored.withColumn("judge_status", F.when(F.col("judge_score") == 3.0, "rejected").otherwise(status_of(F.col("judge_score"), threshold, editor)))


def preference_status(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """FLT-26: validated where all three are there, the answers differ and have 15 characters at least; else flagged."""
    a, b = strip(chosen), strip(rejected)
    sound = (prompt != "") & (F.lower(a) != F.lower(b)) & (F.length(a) >= 15) & (F.length(b) >= 15)
    return F.when(F.coalesce(sound, F.lit(False)), "validated").otherwise("flagged")


def rewrite_first(pairs: Column, better: Column, field: str = "chosen") -> Column:
    """DM-04, JN-16: an array of pairs with ``field`` of the first one replaced where there is something better."""
    return F.transform(pairs, lambda p, i: F.when((i == 0) & better.isNotNull(), p.withField(field, better)).otherwise(p))


def counters(df: DataFrame, status: str = "judge_status", values: tuple[str, ...] = COUNTED) -> DataFrame:
    """AG-09, AG-10: one row with the total and the count of each status."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def budget(usage: DataFrame, cap: int, ts: str = "ts", tokens: str = "tokens", price_per_1000: float = 0.0035) -> DataFrame:
    """AG-04, AG-05, FLT-33, ST-07: a row a month: calls, tokens, cost, percent of the cap and whether work must stop."""
    month = F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month")
    sums = usage.groupBy(month).agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))
    percent = F.round(F.col("tokens") * 100.0 / F.lit(cap), 2)
    return sums.withColumn("cost", F.round(F.col("tokens") / 1000.0 * price_per_1000, 4)).withColumn("percent", percent).withColumn("halted", F.col("tokens") >= cap)


def golden(rows: DataFrame, least: float = 7.5, default: float = 8.0) -> DataFrame:
    """CP-12: instruction, input, output, score of answers judged ``least`` or better; an unjudged one counts as the default."""
    score = F.coalesce(F.col("judge_score").cast("double"), F.lit(default))
    kept = rows.withColumn("score", score).where((F.col("score") >= least) & (F.col("prompt_sft") != "") & (F.col("response_sft") != ""))
    return kept.select(F.col("prompt_sft").alias("instruction"), F.lit("").alias("input"), F.col("response_sft").alias("output"), "score")
