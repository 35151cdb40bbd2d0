"""Merkle manifest of a dataset: sources as trees of documents, below one tree of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.work import saved

RUN = 3  #: consecutive nodes that make one parent
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left: string, right: string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (hex) of the values, each as byte length, colon and value, `-` where NULL."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add idx: the place of each row within its tree by `order`, from 0 without gaps.

    Rows are dealt in ranges of (tree, order) and numbered where they lie; only one
    count per range and tree is summed, so a tree that holds most rows is spread.
    """
    laid = saved(
        nodes.repartitionByRange("tree", *order)
        .sortWithinPartitions("tree", *order)
        .select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place"))
    )
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        laid.groupBy("tree", "range")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("tree", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    return laid.join(starts, ["tree", "range"]).withColumn("idx", F.col("place") + F.col("shift")).drop("range", "place", "shift")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees of leaves (tree, idx, node), each written to shared storage.

    A level has (tree, idx, slot, node, left, right): the digests of the siblings
    before and after a node. Siblings are found by joining the level with itself at
    the two other slots of a run; the rows of slot 0 then give the parents. A tree
    that has come down to one node has no row in the next level.
    """
    found = []
    nodes = leaves
    while True:
        here = nodes.withColumn("slot", F.expr(f"cast(idx % {RUN} as int)"))
        for step in range(1, RUN):
            # the slots are taken in turn: of slot s the step-th sibling is the slot (s + step) mod 3
            place = F.expr(f"idx - slot + (slot + {step}) % {RUN}")
            mates = nodes.select("tree", F.col("idx").alias("mate"), F.col("node").alias(f"node{step}"))
            here = here.withColumn("mate", place).join(mates, ["tree", "mate"], "left").drop("mate")
        after = [F.when(F.col("slot") + s < RUN, F.col(f"node{s}")) for s in range(1, RUN)]
        before = [F.when(F.col("slot") + s >= RUN, F.col(f"node{s}")) for s in range(1, RUN)]
        level = saved(here.select("tree", "idx", "slot", "node", F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right")))
        found.append(level)
        # trees of more than one node go on
        going = level.filter("slot = 0 and (idx > 0 or right <> '')")
        if going.isEmpty():
            return found
        nodes = going.select("tree", F.expr(f"idx div {RUN}").alias("idx"), F.sha2(F.concat("node", "right"), 256).alias("node"))


def roots(found: list[DataFrame]) -> DataFrame:
    """(tree, root): the last node of every tree."""
    lone = [level.filter("idx = 0 and right = ''").select("tree", F.col("node").alias("root")) for level in found]
    frame = lone[0]
    for one in lone[1:]:
        frame = frame.union(one)
    return frame


def paths(found: list[DataFrame], above: DataFrame | None = None, leaves: DataFrame | None = None) -> DataFrame:
    """(tree, idx, path): the siblings of every leaf and of the nodes above it, upwards.

    Built from the roots downwards: a level joins its own siblings with the paths of
    its parents, so only parents carry paths through a shuffle. `above` has
    (tree, path) that goes on beyond the roots. The columns of `leaves`, found by
    (tree, idx), are given along.
    """
    empty = F.array().cast(STEP)
    path = None
    for level in reversed(found):
        kept = ["tree", "idx"]
        if level is found[0] and leaves is not None:
            kept = leaves.columns
            level = level.join(leaves, ["tree", "idx"])
        root = "idx = 0 and left = '' and right = ''"
        own = level.select(
            *kept, F.expr(f"idx div {RUN}").alias("up"), F.expr(f"not ({root})").alias("inner"),
            F.array(F.struct("left", "right")).alias("own"),
        )
        ends = own.filter("not inner")
        ends = ends.join(above, "tree", "left") if above is not None else ends.withColumn("path", empty)
        here = ends.select(*kept, F.coalesce("path", empty).alias("path"))
        if path is not None:
            parents = path.select("tree", F.col("idx").alias("up"), F.col("path").alias("rest"))
            inner = own.filter("inner").join(parents, ["tree", "up"])
            here = here.union(inner.select(*kept, F.concat("own", "rest").alias("path")))
        path = saved(here) if len(kept) == 2 else here
    return path


def folded(node: Column, path: Column) -> Column:
    """The root that a node and the siblings on its path give."""
    return F.aggregate(path, node, lambda acc, at: F.sha2(F.concat(at["left"], acc, at["right"]), 256))


def tampered_leaf(columns: dict[str, Column]) -> Column:
    """Leaf of a row whose text has lost its newlines, where 2 divides the CRC-32 of the id; else of the row as it is."""
    chosen = F.crc32(columns["doc_id"].cast("string")) % 2 == 0
    text = F.when(chosen, F.replace(columns["text"], F.lit("\n"), F.lit(""))).otherwise(columns["text"])
    return leaf_hash(*[text if name == "text" else columns[name] for name in FIELDS])


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, proof and the result of a check against tampering, one row per document.

    A leaf is `leaf_hash` of doc_id, source, lang, n_chars and text. Per source, the
    leaves in the order of doc_id (NULL first; equal ids by leaf) are joined in runs
    of three until one node is left, the subroot; the subroots in the order of their
    sources (NULL first, by bytes) are joined likewise to the root. proof_sha256
    hashes all siblings on the way from the leaf to the root. folded_root is
    computed anew from the tampered leaf (`tampered_leaf`) and the original
    siblings; verified tells whether it is the root.

    NULL in any column is a value of its own, an empty text is `0:`. Texts are
    hashed where they are read and never shuffled, whatever their length. Repeated
    rows are equal leaves side by side. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    columns = {name: docs[name] for name in FIELDS}
    leaves = docs.select(
        columns["doc_id"].alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), columns["source"].cast("string")), F.lit("")).alias("tree"),
        leaf_hash(*columns.values()).alias("leaf"),
        tampered_leaf(columns).alias("odd"),
    )
    rows = saved(numbered(leaves, ["doc_id", "leaf"]))
    found = levels(rows.select("tree", "idx", F.col("leaf").alias("node")))
    subroots = saved(roots(found))
    tops = saved(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "root"), ["source"]))
    upper = levels(tops.select("tree", "idx", F.col("root").alias("node")))
    ways = paths(upper).join(tops.select("idx", "source"), "idx").select(F.col("source").alias("tree"), "path")
    # one row: the root of the tree of sources
    root = roots(upper).select(F.col("root").alias("_root"))
    return (
        paths(found, saved(ways), rows.select("tree", "idx", "doc_id", "leaf", "odd"))
        .join(subroots.withColumnRenamed("root", "subroot"), "tree")
        .join(F.broadcast(root))
        .select(
            "doc_id",
            "leaf",
            "subroot",
            F.col("_root").alias("root"),
            F.sha2(F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), ""), 256).alias("proof_sha256"),
            folded(F.col("odd"), F.col("path")).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
