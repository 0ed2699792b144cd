"""Table maintenance and joins: conforming schemas, keyed upserts, id remapping, diffs and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from millrace.functions import json_fields
from millrace.operators.ranking import with_position


def conform(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """DM-01, PRJ-06: the columns of ``schema``; absent ones are null or a default, dirty values become null."""
    have, defaults = set(df.columns), defaults or {}
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema])


def common_columns(a: DataFrame, b: DataFrame, without: tuple[str, ...] = ("id",)) -> list[str]:
    """PRJ-05: columns of both, in the order of ``a``."""
    return [c for c in a.columns if c in b.columns and c not in without]


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JN-04, JN-10, ST-03: rows of ``work`` without a row in ``done``."""
    return work.join(done.select(key), key, "left_anti")


def with_defaults(own: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """JN-15: ``own`` and the defaults whose key it lacks; columns that a default doesn't have are null."""
    return own.unionByName(pending(defaults, own, key), allowMissingColumns=True)


def needs_enrichment(text: Column, value: Column, sentinels: tuple[str, ...] = ()) -> Column:
    """FLT-22, FLT-24: there is text, and the value is null, blank, an empty list or a sentinel."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & v.isin("", "[]", "null", *sentinels)


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """SNK-03, DM-02: rows of both by key; a new value replaces an old one, in the ``keep_old`` columns the old one stays."""
    cols = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        sides = (f"o.{c}", f"n.{c}") if c in keep_old else (f"n.{c}", f"o.{c}")
        return F.coalesce(*map(F.col, sides))

    return joined.select(key, *[value(c).alias(c) for c in cols])


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SNK-02, SNK-05, SRC-13: of each key the row that comes last in ``order``; rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DM-05, SNK-06: rows whose key isn't in ``gone``."""
    return df.join(gone.select(*keys), keys, "left_anti")


def remap_ids(rows: DataFrame, fk: str, id_map: DataFrame) -> DataFrame:
    """JN-06: foreign keys replaced through id_map (old_id, new_id); rows without a new id are orphans and go.

    An empty map leaves the rows as they are.
    """
    if id_map.isEmpty():
        return rows
    mapped = rows.join(id_map.select(F.col("old_id").alias(fk), "new_id"), fk)
    return mapped.select(*[F.col("new_id").alias(fk) if c == fk else F.col(c) for c in rows.columns])


def merge_tables(tables: list[DataFrame], key: str, *order: str) -> DataFrame:
    """SET-01, CP-08: the bag union of projects' tables with fresh gapless ids from 1, and the column old_id."""
    tagged = [t.withColumn("project_no", F.lit(i)) for i, t in enumerate(tables)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    placed = with_position(union, "project_no", key, *order)
    return placed.withColumnRenamed(key, "old_id").withColumn(key, F.col("position") + 1).drop("position")


def union_records(parts: list[DataFrame]) -> DataFrame:
    """SET-02: records of several sources, of equal ones (by key-sorted JSON) the first; source order decides.

    Adds source_no and line_no of the one that is kept. ``parts`` have the column line_no.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)])
    fields = [c for c in rows.columns if c not in ("source_no", "line_no")]
    signed = rows.withColumn("_sign", F.sha2(json_fields.canonical(fields), 256))
    return signed.groupBy("_sign").agg(F.min_by(F.struct(*rows.columns), F.struct("source_no", "line_no")).alias("r")).select("r.*")


def manifest_diff(before: DataFrame, now: DataFrame, key: str, *signature: str) -> DataFrame:
    """JN-08, JN-09, ST-05: key, status (new, changed, unchanged, deleted) from two manifests."""
    b = before.select(key, F.struct(*signature).alias("_was"), F.lit(True).alias("_before"))
    n = now.select(key, F.struct(*signature).alias("_is"), F.lit(True).alias("_now"))
    status = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_was").eqNullSafe(F.col("_is")), "unchanged").otherwise("changed")
    return b.join(n, key, "full_outer").select(key, status.alias("status"))


def search_all_text(df: DataFrame, query: str) -> DataFrame:
    """FLT-17: rows of which any text column holds ``query``, in either case."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(query))), F.lit(False)) for c in cols], F.lit(False)))


def search_record(df: DataFrame, query: str) -> DataFrame:
    """FLT-18: rows whose JSON holds ``query``, in either case."""
    return df.where(F.lower(F.to_json(F.struct(*df.columns))).contains(query.lower()))


def any_word(line: Column, query: str) -> Column:
    """FLT-19: any of the query's words of over 3 characters occurs in the line."""
    found = [F.lower(line).contains(w) for w in query.lower().split() if len(w) > 3]
    return F.coalesce(reduce(lambda a, b: a | b, found, F.lit(False)), F.lit(False))


def lookup(df: DataFrame, small: DataFrame, key: str, value: str, default, limit_bytes: int = 64 << 20, order: str | None = None) -> DataFrame:
    """JN-07: a value from a small table, the last of a key (in ``order``, or as the rows are read), or a default; it is
    broadcast up to ``limit_bytes``."""
    one = small.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id()).groupBy(key).agg(F.max_by(value, "_at").alias(value))
    size = one.agg(F.count("*").alias("n"), F.sum(F.length(F.col(value).cast("string"))).alias("b")).first()
    one = F.broadcast(one) if (size.b or 0) + 64 * size.n <= limit_bytes else one
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def normalised(c: Column, aliases: dict[str, str], what: str) -> Column:
    """PRJ-13: the one name of a value's aliases (in any case, outer white space off); an unknown value is an error."""
    low = F.lower(F.trim(c))
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(c, F.lit("null"))))
    return F.coalesce(F.try_element_at(names, low), unknown.cast("string"))


def first_seen(df: DataFrame, content: Column, path: str, *order: str) -> DataFrame:
    """WN-02: ``df`` with sha1 and duplicate_of: the first path of equal content, null for that first row itself.

    Firsts are aggregated before the join, so a group of very many copies isn't brought into one task.
    """
    signed = df.withColumn("sha1", F.sha1(content.cast("binary")))
    firsts = signed.groupBy("sha1").agg(F.min(F.struct(*order, path)).alias("_first"))
    joined = signed.join(firsts, "sha1", "left")
    own = F.struct(*order, path)
    return joined.withColumn("duplicate_of", F.when(own != F.col("_first"), F.col(f"_first.{path}"))).drop("_first")
