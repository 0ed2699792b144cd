"""Relational queries over the star schema: joins, grouping, windows and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.tables import with_defaults
from millrace.plans.registry import register, table


@register(
    "rel_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       count(*) AS n_rows FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
       GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark, sf_dir):
    """Quantities and prices by return flag and line status."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.count("*").alias("n_rows"))
    )


@register(
    "document_counts",
    """SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE length(text) >= 100) AS n_long,
       round(100.0 * count(*) FILTER (WHERE length(text) >= 100) / count(*), 1) AS percent_long
       FROM documents GROUP BY lang""",
)
def document_counts(spark, sf_dir):
    """AG-01, FLT-03, MH-08: all documents, those of 100 characters at least, counted in one pass."""
    n_long = F.count_if(F.length("text") >= 100)
    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(
            F.count("*").alias("n_docs"),
            n_long.alias("n_long"),
            F.round(100.0 * n_long / F.count("*"), 1).alias("percent_long"),
        )
    )


@register(
    "default_labels",
    """SELECT doc_id, toxic, quality, false AS is_default FROM labels
       UNION ALL SELECT doc_id, 0, 0, true FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def default_labels(spark, sf_dir):
    """JN-15: labels, and default ones for documents without any."""
    own = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality", F.lit(False).alias("is_default"))
    kinds = dict(own.dtypes)
    zero = [F.lit(0).cast(kinds[c]).alias(c) for c in ("toxic", "quality")]
    return with_defaults(own, table(spark, sf_dir, "documents").select("doc_id", *zero, F.lit(True).alias("is_default")), "doc_id")


@register(
    "part_name_words",
    """WITH w AS (SELECT p_partkey, list_distinct(string_split(trim(lower(p_name)), ' ')) AS a,
       list_distinct(string_split(trim(lower(p_type)), ' ')) AS b FROM part)
       SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS n_shared,
       CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS n_all,
       len(list_filter(a, lambda x: starts_with(x, 'b'))) > 0 AS any_b, len(list_filter(a, lambda x: length(x) <= 4)) = 0 AS all_long,
       array_to_string(list_sort(a)[1:2], ' ') AS first_two FROM w""",
)
def part_name_words(spark, sf_dir):
    """SET-07, JS-08, STR-24: what the word sets of names and types share and hold together, and tests over the words."""
    words = lambda c: F.array_distinct(F.split(F.trim(F.lower(c)), " "))
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", words("p_name").alias("a"), words("p_type").alias("b"))
        .select(
            "p_partkey",
            F.size(F.array_intersect("a", "b")).alias("n_shared"),
            F.size(F.array_union("a", "b")).alias("n_all"),
            F.exists("a", lambda x: x.startswith("b")).alias("any_b"),
            F.forall("a", lambda x: F.length(x) > 4).alias("all_long"),
            F.array_join(F.slice(F.array_sort("a"), 1, 2), " ").alias("first_two"),
        )
    )


@register(
    "dearest_orders",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def dearest_orders(spark, sf_dir):
    """SL-01: rows in a stated order, ties by key; a top report, so no total sort is needed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
