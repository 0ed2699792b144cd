"""The corpus pipeline: what is toxic goes, of near copies one document stays, repeated passages are cut, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import packing, simhash, suffix_dedup, toxicity
from millrace.session import scratch, written

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. The held-out fifth of the labels isn't learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.scored(docs.select(DOCUMENTS), model).where("score < 0.5").select(DOCUMENTS)


def _with_key(docs: DataFrame) -> DataFrame:
    """doc (unique, in the order of doc_id) beside the documents' columns; a null text counts as empty in what follows."""
    first = -(2**63)
    if docs.groupBy(F.coalesce("doc_id", F.lit(first))).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.select(F.coalesce("doc_id", F.lit(first)).alias("doc"), *DOCUMENTS)
    ordered = suffix_dedup.in_text_order(docs.select(DOCUMENTS), *DOCUMENTS)
    return written(ordered.select(F.monotonically_increasing_id().alias("doc"), *DOCUMENTS), "keyed-docs")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of texts with equal or similar word shingles."""
    keyed = _with_key(docs)
    groups = simhash.similar_documents(keyed.select("doc", F.coalesce("text", F.lit("")).alias("text")), n_words=5, similarity=0.8)
    return keyed.join(groups.where("doc = keep").select("doc"), "doc", "left_semi").select(DOCUMENTS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that lie in byte strings that start earlier; documents of which nothing is left go."""

    keyed = _with_key(docs)
    spans = suffix_dedup.repeated_spans(keyed.select("doc", F.coalesce("text", F.lit("")).alias("text")))
    found = suffix_dedup.without_spans(keyed.join(spans, "doc", "left").drop("doc"))
    left = found.where(~(F.col("cut") & (F.col("text") == "")))
    return left.withColumn("n_chars", F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(DOCUMENTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the documents fill: every document's parts with their bins."""
    return packing.pack_documents(docs, packing.CAPACITY)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written once and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
