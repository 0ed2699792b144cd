"""A Merkle manifest of a table in an external-memory node store.

Every row becomes a leaf hash. Leaves are sorted by tree (the source) and key into runs; each level of nodes is a Parquet
table in the order of its coordinates (tree, number in the level), and the next level is read off the one below: every
``FANOUT`` consecutive nodes are one run and become one node. As a level lies in order, runs are put together where they
are read, and only those at the seams of partitions meet by a shuffle. What remains of each tree is a leaf of the top tree.

Proofs go the other way. A level holds runs with all their members, and a merge join by coordinate hands each run what lies
above it: the siblings left and right of each of its ancestors. Only the last step, inside a run, is made for every leaf.

Hashes are lowercase hex sha256 of concatenated inputs, digests as hex text. A leaf hashes its fields one after another, each
as ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value, so no two different rows read alike.

Defined results: null sources are a tree of their own, before all others, which come in the order of their bytes; leaves
ascend by doc_id, nulls first, rows of one doc_id by their leaf hash, and equal rows are leaves side by side; rows with a
null doc_id count as not tampered with; a tree of one leaf has that leaf as its root; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.simhash import join_unique
from millrace.operators.ranking import with_position
from millrace.session import scratch, written

#: Nodes of a run.
FANOUT = 16
#: A step of a proof: the siblings to the left and to the right, concatenated.
PATH = "array<struct<pre:string,post:string>>"


def field(value: Column) -> Column:
    """A value as the leaf hash reads it."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _tree_key(source: Column) -> Column:
    """A key that is never null and has the order of the sources, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def runs_of(nodes: DataFrame, *payload: str) -> DataFrame:
    """tree, idx, n, members, h of the runs of ``nodes`` (tree, idx, n: the tree's nodes, h, payload...); h is the node above.

    A node that is alone in its tree stays as it is.
    """
    members = F.sort_array(F.collect_list(F.struct("idx", "h", *payload)))
    runs = nodes.groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(F.first("n").alias("n"), members.alias("members"))
    joined = F.sha2(F.array_join("members.h", ""), 256)
    return runs.select("tree", "idx", "n", "members", F.when(F.col("n") == 1, F.col("members")[0]["h"]).otherwise(joined).alias("h"))


def build_levels(leaves: DataFrame, *payload: str) -> list[DataFrame]:
    """The stored levels of runs over ``leaves`` (tree, idx, n, h, payload...), the lowest first; trees leave when one node remains."""
    ordered = lambda runs, level: written(runs.sortWithinPartitions("tree", "idx"), f"merkle-level-{level}", keep=True)
    levels = [ordered(runs_of(leaves, *payload), 0)]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > FANOUT:
        nodes = levels[-1].select("tree", "idx", F.ceil(F.col("n") / FANOUT).alias("n"), "h").where("n > 1")
        levels.append(ordered(runs_of(nodes), len(levels)))
        most = -(-most // FANOUT)
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """tree, root: the node that remains of each tree."""
    ends = [level.where(F.col("n") <= FANOUT).select("tree", F.col("h").alias("root")) for level in levels]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def _step(members: Column, at: Column) -> Column:
    """The siblings of the member at a place of its run, as one step; none if the member is alone."""
    hashes = F.transform(members, lambda m: m["h"])
    pre, post = F.array_join(F.slice(hashes, 1, at), ""), F.array_join(F.slice(hashes, at + 2, FANOUT), "")
    return F.when(F.size(members) > 1, F.array(F.struct(pre.alias("pre"), post.alias("post")))).otherwise(F.array().cast(PATH))


def proofs(levels: list[DataFrame], above: DataFrame, *payload: str) -> DataFrame:
    """tree, h, path and ``payload`` of every leaf, and the columns of ``above`` (tree, path, ...), which has what lies above each tree's root.

    Path: the steps from the leaf to the top, in order.
    """
    others = [c for c in above.columns if c not in ("tree", "path")]
    known = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        # Trees whose last run is in this level start here; the others go on from the level above.
        begun = level.where(F.col("n") <= FANOUT).join(above, "tree")
        if known is not None:
            begun = begun.unionByName(level.where(F.col("n") > FANOUT).join(known, ["tree", "idx"]))
        inside = begun.select("tree", "path", *others, "members", F.posexplode("members").alias("at", "m"))
        path = F.concat(_step(F.col("members"), F.col("at")), F.col("path")).alias("path")
        known = inside.select("tree", F.col("m.idx").alias("idx"), F.col("m.h").alias("h"), path, *others, *([F.col(f"m.{c}").alias(c) for c in payload] if k == 0 else []))
        if k:
            known = known.drop("h")
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["pre"], h, s["post"]), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, bottom up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["pre"], s["post"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    The proof of a row is checked against its leaf, or that of its tampered text (A-Z lower-cased) where 5 divides the CRC-32 of doc_id.
    """
    with scratch(docs.sparkSession):
        fields = lambda text: leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
        lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fields(lowered))
        # A number of the row parts equal rows into ranges; they are alike, so it doesn't matter which comes first.
        keyed = docs.select(_tree_key(F.col("source")).alias("key"), "doc_id", fields(F.col("text")).alias("h"), tampered.alias("t"), F.monotonically_increasing_id().alias("row"))
        placed = with_position(written(keyed, "merkle-leaves"), "key", "doc_id", "h", "row")
        trees = placed.groupBy("key").agg(F.min("position").alias("first"), F.count("*").alias("n"))
        trees = written(with_position(trees, "key", name="tree"), "merkle-trees")
        of_tree = trees.select("key", "tree", "first", "n", F.col("n").alias("leaves"))
        leaves = join_unique(placed, of_tree, "key", placed.count()).select("tree", (F.col("position") - F.col("first")).alias("idx"), F.col("leaves").alias("n"), "h", "doc_id", "t")
        levels = build_levels(leaves, "doc_id", "t")
        subroots = roots_of(levels).select(F.col("tree").alias("idx"), F.col("root").alias("h"))
        tops = build_levels(subroots.select(F.lit(0).cast("long").alias("tree"), "idx", F.lit(trees.count()).cast("long").alias("n"), "h"))
        top = roots_of(tops).select("tree", F.array().cast(PATH).alias("path"), "root")
        above = written(proofs(tops, top).select(F.col("idx").alias("tree"), F.col("h").alias("subroot"), "root", "path"), "merkle-above", keep=True)
    found = proofs(levels, above, "doc_id", "t").withColumn("folded_root", folded(F.coalesce("t", "h"), F.col("path")))
    return found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
