"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of tables that :func:`written` made inside open ``scratch`` blocks, innermost last.
_OPEN: list[list[str]] = []


def written(df: DataFrame, label: str = "part", keep: bool = False) -> DataFrame:
    """Writes ``df`` once into the shared folder and returns a reader of it.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. Inside a ``scratch`` block the table goes
    when the block ends, unless ``keep`` is set: then it belongs to the block around.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    level = len(_OPEN) - (2 if keep else 1)
    if level >= 0:
        _OPEN[level].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of intermediate tables."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted at the end; what is still needed is written with ``keep``.

    Shuffle files of jobs that have ended go as well: Spark removes them once the driver's garbage collection finds that no
    plan needs them, which may be much later if the driver has memory to spare.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        removed(spark, _OPEN.pop())
        spark._jvm.java.lang.System.gc()
