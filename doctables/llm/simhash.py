"""SimHash fingerprints of word shingles, linked through deletion variants of their halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.work import components, saved

BLOCK = 1 << 16  #: shingles whose bits are counted at once
COLD = 64  #: buckets of up to so many fingerprints are joined with themselves
SEED = 42


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of one text; see `fingerprints`."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK], ends[at : at + BLOCK])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """Fingerprint (long) of each text.

    A-Z become lower case, words are runs without ASCII white space, shingles are
    `words` words joined by a blank, repeats included (fewer words: all of them). A
    bit is set if it is set in over half of the shingles' XXH64. NULL, empty and
    blank texts have fingerprint zero.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    return run(text)


def links(classes: DataFrame, cold: int = COLD) -> DataFrame:
    """Links (a, b) that connect all fingerprints within two bits; classes (rep, fp), fp unique.

    Of two differing bits, one half of the fingerprint has at most one. So each
    fingerprint is posted under its first half with each bit deleted in turn, and
    under either half whole, and equal keys meet. In a bucket of up to `cold`
    fingerprints all pairs are verified. Members of larger buckets are posted again
    with the other deletions that two bits allow: such a bucket holds at most four
    fingerprints, all within two bits of each other, and each is linked to the
    smallest. No pair is lost in either way, and no bucket is joined in full.
    """
    high, low = F.expr("shiftrightunsigned(fp, 32)"), F.expr("fp & 4294967295L")
    keys = [F.lit(i).cast("long") * (1 << 32) + high.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i)).cast("long")) for i in range(32)]
    keys += [F.lit(32).cast("long") * (1 << 32) + high, F.lit(33).cast("long") * (1 << 32) + low]
    index = classes.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))
    buckets = saved(
        index.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[f(c).alias(f"{name}_{c}") for c in ("rep", "fp") for name, f in (("min", F.min), ("max", F.max))],
        )
        .filter("n > 2 or n = 2 and bit_count(min_fp ^ max_fp) <= 2")
    )
    pairs = buckets.filter("n = 2").select(F.col("min_rep").alias("a"), F.col("max_rep").alias("b"))
    members = saved(index.join(buckets.filter("n > 2").select("key", "n"), "key"))
    few = members.filter(F.col("n") <= cold)
    met = (
        few.alias("x")
        .join(few.alias("y"), "key")
        .filter("x.rep < y.rep and bit_count(x.fp ^ y.fp) <= 2")
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    rest = saved(members.filter(F.col("n") > cold).select("key", "rep", "fp"))
    return saved(pairs.union(met).union(_crowded(rest)).distinct())


def _crowded(rest: DataFrame) -> DataFrame:
    """Links of members (key, rep, fp) of large buckets, by deleting all the bits that may differ."""
    bits = [1 << i for i in range(32)]
    two = [x | y for i, x in enumerate(bits) for y in bits[i:]]
    signed = lambda mask: mask - (1 << 64) if mask >= 1 << 63 else mask
    slot = F.expr("shiftright(key, 32)")
    masks = (
        F.when(slot < 32, F.array(*[F.lit(m).cast("long") for m in bits]))
        .when(slot == 32, F.array(*[F.lit(m).cast("long") for m in two]))
        .otherwise(F.array(*[F.lit(signed(m << 32)).cast("long") for m in two]))
    )
    # under a first half with a deleted bit, that bit may differ as well
    wild = F.when(slot < 32, F.expr("shiftleft(1L, cast(32 + shiftright(key, 32) as int))")).otherwise(F.lit(0).cast("long"))
    posted = rest.select("key", "rep", F.col("fp").bitwiseAND(F.bitwise_not(wild)).alias("fp"), F.explode(masks).alias("mask"))
    posted = posted.withColumn("left", F.expr("fp & ~mask"))
    lowest = posted.groupBy("key", "mask", "left").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count(F.lit(1)).alias("n"))
    found = lowest.filter("n > 1")
    return (
        found.filter("n = 2")
        .select("a", F.col("z").alias("b"))
        .union(
            posted.join(found.filter("n > 2").drop("n", "z"), ["key", "mask", "left"])
            .filter("rep <> a")
            .select("a", F.col("rep").alias("b"))
        )
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id among the documents reachable by links of two or
    fewer differing bits, so equal and repeated texts always share one. A row
    without id has the component of the rows with its fingerprint (NULL if there is
    none) and links nothing itself. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    prints = saved(docs.select(F.col(id_col).cast("long").alias("id"), fingerprints(F.col(text_col), words).alias("fp")))
    classes = saved(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(links(classes))
    of = classes.join(found, classes.rep == found.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(of, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
