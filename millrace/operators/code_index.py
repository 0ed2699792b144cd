"""CP-10, ST-05: the units of a repository, kept up to date by parsing only what changed.

State is a folder of two tables. ``manifest`` has one version a refresh: every file with its (mtime, size), the digest of its
text and the version that parsed it. ``units`` has what each version parsed, and is only added to. A refresh compares files
with the last manifest: unchanged ones keep their version and aren't parsed, new and changed ones are parsed under the new
version, removed ones are no longer named. The units of now are those whose file and version the last manifest names, so
nothing is rewritten and a refresh that fails half-way changes nothing: its version isn't in a manifest.

A refresh under other settings (unit types, whether code is kept, languages) parses everything.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.predicates import UNIT_TYPES
from millrace.operators import brace_units, code_units

LANGUAGES = ("python", "cpp", "cuda", "metal", "typescript")
_ALIASES = {"py": "python", "python3": "python", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "ts": "typescript", "tsx": "typescript", "javascript": "typescript"}
_FILES = "path string, mtime double, size long, sha1 string, error string, parsed_in long, settings string"


@dataclass(frozen=True)
class Settings:
    """What units a refresh makes: unit types (all if empty), whether their code is kept, and of which languages."""

    units: tuple[str, ...] = ()
    store_code: bool = True
    languages: tuple[str, ...] = ("python",)

    def __post_init__(self):
        named = [_ALIASES.get(x.strip().lower(), x.strip().lower()) for x in self.languages]
        if wrong := [x for x in named if x not in LANGUAGES] + [u for u in self.units if u not in UNIT_TYPES]:
            raise ValueError(f"unknown language or unit type: {wrong[0]}")
        object.__setattr__(self, "languages", tuple(dict.fromkeys(named)) or ("python",))

    def signature(self) -> str:
        return json.dumps({"units": sorted(self.units) or sorted(UNIT_TYPES), "store_code": self.store_code, "languages": sorted(self.languages)})


def _language(path: str) -> str | None:
    extension = re.sub(r".*(?=\.)", "", path.lower(), flags=re.S)
    return "python" if extension == ".py" else brace_units.EXTENSIONS.get(extension)


def _parsed(settings: Settings):
    """Digest, error and units of a file."""

    @F.pandas_udf(f"struct<sha1:string,error:string,units:{code_units.UNITS}>")
    def parse(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for path, text in zip(paths, texts, strict=True):
            error = None
            if _language(path) == "python":
                units = code_units.python_units(text)
                if not units:
                    try:
                        ast.parse(text or "")
                    except (SyntaxError, ValueError, RecursionError) as e:
                        error = f"{type(e).__name__}: {e}"
            else:
                units = brace_units.brace_units(text, path)
            units = [u if settings.store_code else u | {"code": None} for u in units if not settings.units or u["unit_type"] in settings.units]
            out.append((None if error else hashlib.sha1((text or "").encode("utf-8", "surrogatepass")).hexdigest(), error, units))
        return pd.DataFrame(out, columns=["sha1", "error", "units"])

    return parse


def _manifest(spark: SparkSession, state: str) -> DataFrame | None:
    """The last manifest, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    every = spark.read.schema(_FILES + ", version long").parquet(f"{state}/manifest")
    last = every.agg(F.max("version")).first()[0]
    return None if last is None else every.where(F.col("version") == last)


def refresh(files: DataFrame, state: str, settings: Settings | None = None) -> dict[str, int]:
    """Brings the units in ``state`` up to date with ``files`` (path, mtime, size, text; one row a path).

    Returns how many files were unchanged, parsed (of these: in error) and removed. Files of other languages don't count.
    """
    spark, settings = files.sparkSession, settings or Settings()
    wanted = [e for e, lang in (brace_units.EXTENSIONS | {".py": "python"}).items() if lang in settings.languages]
    files = files.where(F.lower("path").rlike("(?:" + "|".join(map(re.escape, wanted)) + r")\z"))
    old = _manifest(spark, state)
    version, same = 1, F.lit(False)
    known = files
    if old is not None:
        version = old.agg(F.max("version")).first()[0] + 1
        known = files.join(old.select("path", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "size", "sha1", "error", "parsed_in", "settings")]), "path", "left")
        same = F.coalesce((F.col("old_mtime") == F.col("mtime")) & (F.col("old_size") == F.col("size")) & (F.col("old_settings") == settings.signature()), F.lit(False))
    # Only these meet the parser.
    fresh = known.where(~same).select("path", "mtime", "size", _parsed(settings)("path", "text").alias("p"))
    fresh.select("path", "mtime", "size", "p.sha1", "p.error", "p.units").write.mode("overwrite").parquet(f"{state}/units/version={version}")
    parsed = spark.read.parquet(f"{state}/units/version={version}").select("path", "mtime", "size", "sha1", "error", F.lit(version).cast("long").alias("parsed_in"))
    if old is not None:
        parsed = parsed.unionByName(known.where(same).select("path", "mtime", "size", F.col("old_sha1").alias("sha1"), F.col("old_error").alias("error"), F.col("old_parsed_in").alias("parsed_in")))
    rows = parsed.withColumn("settings", F.lit(settings.signature()))
    # A version without files still has a row, so that all files can be removed.
    rows = rows.unionByName(spark.createDataFrame([(None, None, None, None, None, None, settings.signature())], _FILES))
    rows.write.mode("overwrite").parquet(f"{state}/manifest/version={version}")
    new = _manifest(spark, state).where("path IS NOT NULL")
    now = new.agg(F.count_if(F.col("parsed_in") == version).alias("parsed"), F.count_if((F.col("parsed_in") == version) & F.col("error").isNotNull()).alias("errors"), F.count("*").alias("n")).first()
    gone = 0 if old is None else old.where("path IS NOT NULL").join(new.select("path"), "path", "left_anti").count()
    return {"unchanged": now.n - now.parsed, "parsed": now.parsed, "errors": now.errors, "removed": gone}


def current_units(spark: SparkSession, state: str) -> DataFrame:
    """path and the columns of UNITS as of the last refresh."""
    named = _manifest(spark, state).where("path IS NOT NULL").select("path", F.col("parsed_in").alias("version"))
    made = spark.read.option("basePath", f"{state}/units").parquet(f"{state}/units").select("path", F.col("version").cast("long").alias("version"), "units")
    return made.join(named, ["path", "version"], "left_semi").select("path", F.explode("units").alias("u")).select("path", "u.*")


def compacted(spark: SparkSession, state: str, target: str) -> None:
    """Writes the units and the manifest of now as the only version of another state folder."""
    last = _manifest(spark, state)
    made = spark.read.option("basePath", f"{state}/units").parquet(f"{state}/units").withColumn("version", F.col("version").cast("long"))
    kept = made.join(last.select("path", F.col("parsed_in").alias("version")), ["path", "version"], "left_semi").drop("version")
    kept.write.mode("overwrite").parquet(f"{target}/units/version=1")
    last.drop("version").withColumn("parsed_in", F.lit(1).cast("long")).write.mode("overwrite").parquet(f"{target}/manifest/version=1")
