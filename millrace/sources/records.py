"""Reading and writing records: JSON lines, CSV look-ups, binary files, catalogues, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.export import valid_record
from millrace.operators.tables import last_wins


def read_json_lines(spark: SparkSession, path: str, schema: StructType, keep_corrupt: bool = False) -> DataFrame:
    """SRC-16: records of JSON lines under a schema; blank lines go, corrupt ones too unless their text is asked for."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"), F.col("value").alias("line"))
    return parsed.select("r.*", "ok", "line") if keep_corrupt else parsed.where("ok").select("r.*")


def catalogue(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """SRC-17, AG-11: name, bytes, lines of the record files under a path."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path).select("value", "_metadata.file_name", "_metadata.file_size")
    return rows.groupBy(F.col("file_name").alias("name")).agg(F.max("file_size").alias("bytes"), F.count_if(F.trim("value") != "").alias("lines"))


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: filename, snippet of the second and third CSV column; short rows go, the last of a file name stays."""
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    name, text = rows.columns[1], rows.columns[2]
    placed = rows.select(F.col(name).alias("filename"), F.col(text).alias("snippet"), F.monotonically_increasing_id().alias("n")).where("filename IS NOT NULL AND snippet IS NOT NULL")
    return last_wins(placed, ["filename"], ["n"]).drop("n")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-01, SRC-18, SRC-22: path (below the root), content, size, modified of all files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    root = F.lit(path.rstrip("/") + "/")
    below = F.substring_index(F.col("path"), root, -1)
    return found.select(below.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def census(files: DataFrame) -> DataFrame:
    """SRC-22, AG-15: files and megabytes by extension and top folder (grouping sets in one pass)."""
    rows = files.select(F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1)).alias("ext"), F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("").alias("folder"), "size")
    return rows.groupingSets([["ext"], ["folder"]], "ext", "folder").agg(F.count("*").alias("files"), F.round(F.sum("size") / 1048576, 2).alias("mb"))


def listing_signature(files: DataFrame) -> DataFrame:
    """SRC-25: one row whose signature changes when any file does; order doesn't matter, and no list is gathered."""
    h = F.xxhash64("path", "size").cast("decimal(38,0)")
    return files.agg(F.md5(F.concat_ws(":", F.count("*"), F.sum(h), F.bit_xor(F.xxhash64("size", "path"))).cast("binary")).alias("signature"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """SNK-01, SNK-15: valid records as JSON lines and as Parquet beside; an empty set has JSON only. True if there was any."""
    kept = df.where(valid_record(df))
    kept.write.mode(mode).json(f"{path}.jsonl")
    if kept.isEmpty():
        return False
    kept.write.mode(mode).parquet(f"{path}.parquet")
    return True
