r"""Filter interaction audit by a subset-zeta transform.

Every row fails a subset of the filters, its mask. One count a mask and part is all that the audit needs: summed over the
subsets of a set of filters (the zeta transform: one pass a filter over an array of 2**n counts), the counts tell how many
rows survive every subset. A step of an order is the difference between two neighbouring subsets, for all rows and for the
labelled ones alike, so all n! orders come from one scan of the texts.

The five filters of :func:`text_masks`, as bits from the least: A under 200 words; B fewer distinct words than half of all;
C over 2 % of the code points are in A-Z; D holds one of ``#$%&*|``; E equals the text of a smaller doc_id anywhere in the
table. Words are maximal ``[^\x20\x09-\x0D]+``, case-sensitive.

Defined results: a null text is empty (no words, fails A); a null source and an empty one are the part ''; a row whose
doc_id is null fails E for no text and makes no other fail; rows of one doc_id and text don't make each other fail E; a
label counts if any row of ``labels`` for that id has it, null labels and null ids count as no label; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.simhash import HOT_KEYS, HOT_ROWS
from millrace.session import scratch, written

FILTERS = "ABCDE"
#: What is counted of a mask: rows, rows of good quality, toxic rows.
COUNTS = ("n", "good", "toxic")


def text_masks(text: Column) -> Column:
    """The bits A to D of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # One array of words serves both counts.
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda i, fails: F.when(fails, F.lit(1 << i)).otherwise(0)
    by_words = F.transform(F.array(n), lambda c: bit(0, c["all"] < 200) + bit(1, c["distinct"].cast("long") * 100 < c["all"].cast("long") * 50))[0]
    return (by_words + bit(2, capitals.cast("long") * 100 > F.length(text).cast("long") * 2) + bit(3, text.rlike(r"[#$%&*|]"))).cast("int")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the flags good and toxic of their doc_id; ids of very many rows meet their flags by broadcast."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    total = rows.count()
    # At most HOT_KEYS ids, as each has more than this part of all rows.
    hot = F.broadcast(rows.groupBy("doc_id").agg(F.count("*").alias("m")).where(F.col("doc_id").isNotNull() & (F.col("m") > max(HOT_ROWS, total // HOT_KEYS))).select("doc_id"))
    of_hot = F.broadcast(flags.join(hot, "doc_id", "left_semi"))
    known = rows.where("doc_id is not null")
    joined = known.join(hot, "doc_id", "left_semi").join(of_hot, "doc_id", "left").unionByName(known.join(hot, "doc_id", "left_anti").join(flags, "doc_id", "left"))
    return joined.unionByName(rows.where("doc_id is null"), allowMissingColumns=True).fillna(0, ["good", "toxic"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the number of rows of each mask of failed filters, in all and of those labelled so."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_masks(F.col("text")).alias("mask")
    )
    # Repeated rows are one from here on.
    rows = written(rows.groupBy("same", "mask", "part", "doc_id").agg(F.count("*").alias("n")), "audit-rows")
    flagged = _labelled(rows, labels)
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    # A text's rows of one part and label; of those of the least id, whose number is beside it, none fails E.
    kinds = flagged.groupBy("same", "mask", "part", "good", "toxic", "doc_id").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(known).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    kinds = written(kinds, "audit-kinds")
    # Only texts of several rows can fail E; a text has at most nine kinds a part.
    first = kinds.groupBy("same").agg(F.min("least.doc_id").alias("first"))
    kinds = kinds.join(first, "same")
    free = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    cases = F.array(F.struct("mask", free.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - free).alias("n")))
    split = kinds.select("part", "good", "toxic", F.explode(cases).alias("c")).where("c.n > 0")
    when = lambda c: F.sum(F.when(F.col(c) == 1, F.col("c.n")).otherwise(0))
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), when("good").alias("good"), when("toxic").alias("toxic"))


def survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """part and for each of COUNTS an array: at S, how many rows fail no filter of the subset S (bits).

    Rows that survive S have masks within the other filters, so S is read from the zeta transform at S's complement.
    """
    size = 1 << n_filters
    slots = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(size)])
    sums = counts.groupBy("part").agg(*[slots(c).alias(c) for c in COUNTS])
    for bit in (1 << i for i in range(n_filters)):
        # A subset with the bit takes in what the same subset without it holds.
        step = lambda a, bit=bit: F.transform(a, lambda x, i: F.when(i.bitwiseAND(bit) != 0, x + F.get(a, i - bit)).otherwise(x))
        sums = sums.select("part", *[step(F.col(c)).alias(c) for c in COUNTS])
    return sums.select("part", *[F.reverse(c).alias(c) for c in COUNTS])  # the complement of S is size - 1 - S


def _steps(filters: str) -> tuple[str, str]:
    """All steps of all orders as JSON, and their type: the order, the step's number, its filter's bit, the bits before it."""
    rows = []
    for order in permutations(range(len(filters))):
        for i, f in enumerate(order):
            rows.append({"o": "".join(filters[k] for k in order), "s": i + 1, "bit": 1 << f, "before": sum(1 << k for k in order[:i])})
    return json.dumps(rows), "array<struct<o:string,s:int,bit:int,before:int>>"


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of all ``filters`` and step, from mask counts (part, mask, n, good, toxic); at most seven filters, as all orders are listed."""
    k = len(filters)
    alive = survivors(counts, k)
    lost = lambda c, bit, before: F.get(F.col(c), before) - F.get(F.col(c), before.bitwiseOR(bit))
    # A filter's removals over all orders: a set S of others comes before it in |S|! (k - 1 - |S|)! of them.
    weight = F.array(*[F.lit(math.factorial(bin(s).count("1")) * math.factorial(max(0, k - 1 - bin(s).count("1")))).cast("long") for s in range(1 << k)])
    subsets = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    value = lambda bit: F.aggregate(F.filter(subsets, lambda s: s.bitwiseAND(bit) == 0), F.lit(0).cast("long"), lambda acc, s: acc + F.get(weight, s) * lost("n", bit, s))
    values = F.array(*[value(F.lit(1 << i)) for i in range(k)])
    listed, schema = _steps(filters)
    steps = alive.withColumn("values", values).withColumn("step_", F.explode(F.from_json(F.lit(listed), schema)))
    bit, before, every = F.col("step_.bit"), F.col("step_.before"), F.lit((1 << k) - 1)
    removed = lost("n", bit, before)
    return steps.select(
        "part",
        F.col("step_.o").alias("filter_order"),
        F.col("step_.s").alias("step"),
        F.get("n", before.bitwiseOR(bit)).alias("kept"),
        removed.alias("removed"),
        (lost("n", bit, F.lit(0)) - removed).alias("redundant"),
        lost("n", bit, every - bit).alias("unique_fails"),
        lost("good", bit, before).alias("good_lost"),
        lost("toxic", bit, before).alias("toxic_lost"),
        F.get("values", F.round(F.log2(bit)).cast("int")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over ``docs`` (doc_id, text, source), by source."""
    with scratch(docs.sparkSession):
        counts = written(mask_counts(docs, labels), "mask-counts", keep=True)
    return audit_orders(counts)
