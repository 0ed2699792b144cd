"""Counts and checks of projects: merges, coverage files, storage and strict gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_audit(parts: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """AG-16: table_name, n_rows, n_missing, status of each table (name, rows, columns that must not be null): failed without
    rows, warning with nulls, else passed."""

    def one(name: str, df: DataFrame, needed: list[str]) -> DataFrame:
        lacking = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed], F.lit(False))
        return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count_if(lacking).alias("n_missing"))

    counted = reduce(DataFrame.unionByName, [one(*p) for p in parts])
    return counted.withColumn("status", F.when(F.col("n_rows") == 0, "failed").when(F.col("n_missing") > 0, "warning").otherwise("passed"))


def project_status(projects: DataFrame, articles: DataFrame, enrichments: DataFrame, artefacts: DataFrame) -> DataFrame:
    """AG-22: each project with its counts of articles and enrichments (0 where there are none) and whether it has artefacts."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    out = projects.select("project_id").join(count(articles, "n_articles"), "project_id", "left").join(count(enrichments, "n_enrichments"), "project_id", "left")
    out = out.join(artefacts.select("project_id").distinct().withColumn("has_artefacts", F.lit(True)), "project_id", "left")
    return out.na.fill(0, ["n_articles", "n_enrichments"]).na.fill({"has_artefacts": False})


def storage_saved(before: Column, after: Column) -> Column:
    """AG-13: an aggregate: percent of storage saved, one decimal; 0 where there was nothing."""
    return F.coalesce(F.round((1 - F.try_divide(F.sum(after), F.sum(before))) * 100, 1), F.lit(0.0))


def gate(counters: DataFrame, *bad: str) -> DataFrame:
    """ST-08: counters with exit_code: 2 if any of the columns ``bad`` is over 0, and may_go_on."""
    failed = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in bad])
    return counters.withColumn("exit_code", F.when(failed, 2).otherwise(0)).withColumn("may_go_on", F.col("exit_code") == 0)


def skipped(files: DataFrame) -> DataFrame:
    """SNK-08: path, reason of what wasn't read."""
    return files.where("reason IS NOT NULL").select("path", "reason")


def manifest(files: DataFrame, errors: DataFrame) -> DataFrame:
    """SNK-09: path, size, modified, error of every file; the error is that of its parse (path, error), if any."""
    return files.select("path", "size", "modified").join(errors.select("path", "error"), "path", "left")


def write_sidecars(files: DataFrame, errors: DataFrame, folder: str) -> None:
    """SNK-08, SNK-09: skipped files and the manifest as JSON lines beside a scan."""
    skipped(files).write.mode("overwrite").json(f"{folder}/skipped.jsonl")
    manifest(files, errors).write.mode("overwrite").json(f"{folder}/manifest.jsonl")


def numbered_samples(rows: DataFrame, project: str, key: str) -> DataFrame:
    """WN-13, STR-29: rows with sample_id ``project#position`` by their place in all files."""
    from millrace.operators.ranking import with_position

    return with_position(rows, key).withColumn("sample_id", F.concat(F.lit(f"{project}#"), F.col("position").cast("string"))).drop("position")


def write_tokens(rows: DataFrame, path: str) -> None:
    """SNK-10: token rows as JSON lines."""
    rows.write.mode("overwrite").json(path)
