"""Mixing sources to target weights: whole passes, then a subset of documents that fits the rest of a budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.work import forget, saved

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DP_BUDGET = 1 << 16  #: the dynamic program covers budgets up to this, or twice the longest document
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets (source, source_size, target) for sizes (source, size).

    Sources in code-point order, NULL last, have the weights in turn and share the
    sum of all sizes. A target stops at `repeats` times its source's size; the excess
    is shared again by weight among the others until none is above. Each round is an
    aggregation to three numbers; the sources never leave Spark.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    known = saved(totals.select("source", "source_size", weight.alias("weight")))
    top = F.col("source_size") * F.lit(float(repeats))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    rate, full = None, -1
    while True:
        capped = F.lit(False) if rate is None else F.col("weight") * rate >= top
        row = known.agg(
            F.sum(F.when(capped, top)).alias("at_top"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("full"),
        ).first()
        if row.full == full or not row.open:
            break
        rate, full = (total - (row.at_top or 0.0)) / row.open, row.full
    target = F.least(top, F.col("weight") * F.lit(rate if rate is not None else 0.0))
    return known.select("source", "source_size", target.cast("double").alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum as near `budget` as can be found.

    lengths are distinct and positive. An even share of each length is taken first,
    so every length is represented; longest-first steps bring the rest below the
    reach of the dynamic program; that solves the bounded knapsack over the
    documents left, for the largest reachable sum at most the rest, and one more
    document is added if that comes nearer.
    """
    order = np.argsort(-lengths, kind="stable")
    length, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((length * count).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    reach = max(DP_BUDGET, 2 * int(length[0]))
    aim = max(0, budget - reach // 2)
    taken = (count * (aim / total)).astype(np.int64)
    rest = budget - int((length * taken).sum())
    for i in range(len(length)):
        if rest <= reach:
            break
        more = min(int(count[i] - taken[i]), (rest - reach // 2) // int(length[i]))
        if more > 0:
            taken[i] += more
            rest -= more * int(length[i])
    taken += _bounded_knapsack(length, count - taken, rest)
    left = budget - int((length * taken).sum())
    spare = np.flatnonzero(taken < count)
    if left > 0 and len(spare):
        near = spare[np.argmin(np.abs(length[spare] - left))]
        if abs(left - int(length[near])) < left:
            taken[near] += 1
    out = np.empty_like(taken)
    out[order] = taken
    return out


def _bounded_knapsack(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Copies of each length whose sum is the largest reachable one at most `budget`.

    Reachable sums are the bits of one integer; every (length, multiple) item shifts
    it. first[s] keeps the item that reached s first, which leads back to the items.
    """
    reached, full = 1, (1 << (budget + 1)) - 1
    items: list[tuple[int, int]] = []
    first = np.full(budget + 1, -1, dtype=np.int32)
    for i in np.flatnonzero((count > 0) & (length <= budget)):
        left, step = min(int(count[i]), budget // int(length[i])), 1
        while left > 0:
            take = min(step, left)
            fresh = ((reached << (take * int(length[i]))) & full) & ~reached
            if fresh:
                raw = np.frombuffer(fresh.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
                first[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: budget + 1])] = len(items)
                items.append((int(i), take))
                reached |= fresh
            if reached >> budget & 1:
                break
            left, step = left - take, step * 2
        if reached >> budget & 1:
            break
    chosen = np.zeros(len(length), dtype=np.int64)
    at = reached.bit_length() - 1
    while at > 0:
        i, take = items[first[at]]
        chosen[i] += take
        at -= take * int(length[i])
    return chosen


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED,
) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, passes, taken.

    size is the number of words. Every document of a source is taken as often as its
    target holds the whole source; for the rest of the target the number of documents
    of each exact length is fitted by subset sum, and that many are chosen by a
    seeded hash of id and text. taken = passes * size, passes at most `repeats`. Reruns
    agree; rows that are equal in id and text are interchangeable. Documents without
    words take nothing; NULL sources are one source, the last. Long groups of equal
    source and length are ranked by bins of the hash, so only the one bin at the
    boundary is sorted.
    """
    sized = saved(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
        )
    )
    targets = saved(source_targets(sized, weights, repeats))
    lengths = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = lengths.join(targets, lengths["source"].eqNullSafe(targets["source"])).select(
        targets["source"], "size", "n", "source_size", "target"
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(repeats, int(target // total))
        rest = 0 if whole == repeats else int(round(target - whole * total))
        extra = fit_lengths(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rest)
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "whole": whole, "extra": extra})

    fitted = saved(plan.groupBy("source").applyInPandas(fit, "source string, size long, whole long, extra long"))
    drawn = sized.withColumn("bin", F.shiftrightunsigned("draw", 52))
    bins = drawn.filter("size > 0").groupBy("source", "size", "bin").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    bins = (
        bins.alias("b")
        .join(fitted.alias("f"), F.expr("b.source <=> f.source and b.size = f.size"))
        .selectExpr("b.source", "b.size", "bin", "whole", "extra - before as wanted", "n")
    )
    decided = (
        drawn.alias("d")
        .join(bins.alias("b"), F.expr("d.source <=> b.source and d.size = b.size and d.bin = b.bin"), "left")
        .selectExpr("d.*", "coalesce(whole, 0) as whole", "coalesce(wanted, 0) as wanted", "coalesce(n, 0) as n")
    )
    clear = decided.filter("wanted <= 0 or wanted >= n").selectExpr("id", "source", "size", "whole + if(wanted > 0, 1, 0) as passes")
    ranked = Window.partitionBy("source", "size", "bin").orderBy("draw", "id")
    edge = (
        decided.filter("wanted > 0 and wanted < n")
        .withColumn("at", F.row_number().over(ranked))
        .selectExpr("id", "source", "size", "whole + if(at <= wanted, 1, 0) as passes")
    )
    return (
        clear.union(edge)
        .alias("d")
        .join(targets.alias("t"), F.expr("d.source <=> t.source"))
        .selectExpr(f"id as `{id_col}`", "size", "d.source as source", "source_size", "target", "passes", "passes * size as taken")
    )
