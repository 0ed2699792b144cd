"""Finding what is known: keyword search over articles and their enrichments, context for a question, and what it adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import knowledge_gain, preview, strip
from millrace.operators.tables import any_word, search_all_text


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """SL-11: the first n rows, in the order of a key."""
    return df.orderBy(key).limit(n)


def keyword_search(articles: DataFrame, enrichments: DataFrame, query: str, n: int = 10) -> DataFrame:
    """CP-06: the first n articles that hold ``query`` in any text column of theirs or of their enrichment, with previews."""
    told = enrichments.select(F.col("article_id").alias("id"), *[F.col(c).alias(f"e_{c}") for c in enrichments.columns if c != "article_id"])
    found = search_all_text(articles.join(told, "id", "left"), query)
    return first_rows(found, n, "id").select("id", "title", preview(F.col("text")).alias("text_preview"), preview(F.coalesce("e_summary", F.lit(""))).alias("summary_preview"))


def matching_lines(lines: DataFrame, query: str, n: int) -> DataFrame:
    """FLT-19, FLT-18: the first n record lines with any longer word of the question."""
    return first_rows(lines.where(any_word(F.col("line"), query)), n, "line_no")


def knowledge_gap(base: Column, enriched: Column) -> Column:
    """UD-19: the offline verdict on what an enriched answer adds: gain in percent and how it reads."""
    a, b = strip(F.coalesce(base, F.lit(""))), strip(F.coalesce(enriched, F.lit("")))
    gain = F.when((a == "") & (b == ""), F.lit(0)).otherwise(knowledge_gain(a, b))
    return F.struct(gain.alias("gain"), F.when(gain >= 60, "high").when(gain >= 30, "medium").otherwise("low").alias("level"))


def simulated(questions: DataFrame, articles: DataFrame, hits: DataFrame, n: int = 3) -> DataFrame:
    """CP-13: question_id, context and gap of each question (question_id, base_answer): the texts of its n best hits
    (question_id, id, rank) in order are what an answer could use; the gap is measured against them."""
    told = hits.where(F.col("rank") <= n).join(articles.select("id", "text"), "id")
    joined = told.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    out = questions.join(joined, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return out.select("question_id", "context", knowledge_gap(F.col("base_answer"), F.col("context")).alias("gap")).select("question_id", "context", "gap.*")
