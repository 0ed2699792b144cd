"""Training records from enriched documents: instruction, preference, chat and code sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import json_fields as J
from millrace.functions.text import is_boilerplate, is_boilerplate_article, strip, summary_usable

#: Questions whose answer is an article's summary.
SUMMARY_QUESTIONS = (
    "Give a short overview of \u201c{title}\u201d ({dataset}, {year}).",
    "What does \u201c{title}\u201d from {dataset} ({year}) deal with?",
    "Name the main points of \u201c{title}\u201d, which {dataset} brought in {year}.",
)


def valid_record(df: DataFrame) -> Column:
    """FLT-16: two messages at least, or a span or its start, or an instruction (prompt) with an output (chosen)."""
    have = set(df.columns)
    either = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs if c in have], F.lit(""))
    said = (strip(either("instruction", "prompt")) != "") & (strip(either("output", "chosen")) != "")
    if "messages" in have:
        said = said | (F.coalesce(F.size("messages"), F.lit(0)) >= 2)
    for c in ("text_span", "start_char"):
        if c in have:
            said = said | F.col(c).isNotNull()
    return said


def enriched(articles: DataFrame, enrichments: DataFrame, filter_boilerplate: bool = True) -> DataFrame:
    """JN-01, FLT-05, FLT-06: enrichments of articles that aren't excluded or boilerplate."""
    kept = enrichments.where(F.coalesce("is_excluded", F.lit(0)) == 0) if "is_excluded" in enrichments.columns else enrichments
    joined = kept.join(articles.select(F.col("id").alias("article_id"), "title", "year"), "article_id")
    return joined.where(~is_boilerplate_article(F.col("title"), F.coalesce("summary", F.lit("")))) if filter_boilerplate else joined


def instructions(rows: DataFrame, qa: str = "sft_qa", filter_boilerplate: bool = True) -> DataFrame:
    """article_id, instruction, input, output from question-answer pairs. FLT-34 drops boilerplate pairs one by one."""
    pairs = J.question_answers(F.col(qa))
    if filter_boilerplate:
        pairs = F.filter(pairs, lambda p: ~is_boilerplate(p["question"]) & ~is_boilerplate(p["answer"]))
    return rows.select("article_id", F.explode(pairs).alias("p")).select("article_id", F.col("p.question").alias("instruction"), F.lit("").alias("input"), F.col("p.answer").alias("output"))


def summaries(rows: DataFrame, dataset: str, summary: str = "summary") -> DataFrame:
    """PRJ-07, FLT-29: a question for the summary; which of SUMMARY_QUESTIONS it is follows from the article's id."""
    known = {"title": F.col("title"), "year": F.coalesce(F.col("year").cast("string"), F.lit("year unknown")), "dataset": F.lit(dataset)}

    def asked(question: str) -> Column:
        # Text and placeholders alternate.
        parts = re.split(r"\{(\w+)\}", question)
        return F.concat(*[known[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    prompt = F.element_at(F.array(*map(asked, SUMMARY_QUESTIONS)), F.pmod(F.xxhash64("article_id"), F.lit(len(SUMMARY_QUESTIONS))).cast("int") + 1)
    usable = rows.where(summary_usable(F.col(summary)) & (F.col("title") != ""))
    return usable.select("article_id", prompt.alias("instruction"), F.lit("").alias("input"), strip(F.col(summary)).alias("output"))


def preference_pairs(rows: DataFrame, pairs: str = "dpo_pairs", filter_boilerplate: bool = True) -> DataFrame:
    """article_id, prompt, chosen, rejected."""
    found = J.preferences(F.col(pairs))
    if filter_boilerplate:
        found = F.filter(found, lambda p: ~is_boilerplate(p["prompt"]) & ~is_boilerplate(p["chosen"]) & ~is_boilerplate(p["rejected"]))
    return rows.select("article_id", F.explode(found).alias("p")).select("article_id", "p.prompt", "p.chosen", "p.rejected")


def chats(rows: DataFrame, chat: str = "multi_turn_chat", qa: str = "sft_qa") -> DataFrame:
    """article_id, messages: the valid dialogue of an article, or else one of two turns for each of its pairs. FLT-27."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    pairs = F.transform(F.filter(J.question_answers(F.col(qa)), lambda p: ~is_boilerplate(p["question"]) & ~is_boilerplate(p["answer"])), lambda p: F.array(turn("user", p["question"]), turn("assistant", p["answer"])))
    whole = J.messages(F.col(chat))
    return rows.select("article_id", F.explode(F.when(whole.isNotNull(), F.array(whole)).otherwise(pairs)).alias("messages"))


def with_code(instruction: Column, code: Column, language: str = "python") -> Column:
    """PRJ-09: an instruction followed by its fenced code, if there is any."""
    return F.when(strip(F.coalesce(code, F.lit(""))) != "", F.concat(instruction, F.lit(f"\n\n```{language}\n"), code, F.lit("\n```"))).otherwise(instruction)


def export_sets(articles: DataFrame, enrichments: DataFrame, dataset: str, language: str = "bilingual") -> dict[str, DataFrame]:
    """CP-01, SET-08, FLT-39: the sets of a project by file name, as far as its language asks for them."""
    rows = enriched(articles, enrichments)
    out: dict[str, DataFrame] = {}
    for code, prefix in (("en", ""), ("tr", "tr_")):
        if language not in ("bilingual", code) or f"{prefix}sft_qa" not in rows.columns:
            continue
        qa = instructions(rows, f"{prefix}sft_qa")
        told = summaries(rows, dataset, "summary" if code == "en" else "turkish_summary")
        out[f"{prefix}sft_dataset"] = qa.unionByName(told).drop("article_id")
        out[f"{prefix}dpo_dataset"] = preference_pairs(rows, f"{prefix}dpo_pairs").drop("article_id")
        out[f"{prefix}chat_dataset"] = chats(rows, f"{prefix}multi_turn_chat", f"{prefix}sft_qa").drop("article_id")
    return out


def ranked_answers(answers: Column) -> Column:
    """SL-04, AG-19: answers (accepted, score, body), the accepted first, then by score; ties keep their order."""
    placed = F.transform(answers, lambda a, i: F.struct(F.when(a["accepted"], 0).otherwise(1).alias("k"), (-a["score"]).alias("s"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(placed), lambda x: x["a"])


def rejected_answer(ranked: Column, least: int = 1) -> Column:
    """SL-05: the worst answer but the first that isn't accepted and scores ``least`` less than the first; null if none."""
    first = F.try_element_at(ranked, F.lit(1))
    others = F.filter(ranked, lambda a, i: (i > 0) & ~a["accepted"] & (first["score"] - a["score"] >= least))
    return F.try_element_at(others, F.lit(-1))


def strict_dialogue(messages: Column) -> Column:
    """FLT-28: the first four turns are user, assistant, user, assistant, and none of them is blank."""
    four = F.slice(messages, 1, 4)
    roles = F.transform(four, lambda t: t["role"]) == F.array(*map(F.lit, ("user", "assistant", "user", "assistant")))
    return roles & F.forall(four, lambda t: strip(F.coalesce(t["content"], F.lit(""))) != "")
