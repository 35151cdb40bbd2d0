"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.vectors import by_length, sampled, unit, usable
from doctables.llm.work import saved

SAMPLE = 4096  #: vectors that the pivots are chosen from and that show how distances are spread, the bound of what the driver reads
PIVOTS = 128  #: least number of pivots; a large table has a quarter of the square root of its vectors
RANKED = 96  #: nearest pivots whose order represents a vector
POSTED = 12  #: least number of nearest pivots whose inverted files list a vector
PROBES = 128  #: queries whose true neighbours tell how many files and how far a distance are needed
RECALL = 0.98  #: share of the true neighbours of the probes that must be among the candidates
REACHED = 0.995  #: share of them that must stand in a file the probe looks into
LEVELS = 256  #: steps of footrule distance
SLACK = 1e-9  #: more than a cosine from a matrix product can be off
BLOCK = 2048  #: vectors of a block of an inverted file
QUERY_BLOCK = 256


def permutations(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each vector's order of pivots, nearest first."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable").astype(np.uint16)


def spread_out(units: np.ndarray, size: int) -> np.ndarray:
    """At most `size` of the vectors, farthest first: each is the one least like all before it.

    Near copies of one vector give a second pivot only when nothing else is left.
    """
    chosen, like = [0], units @ units[0]
    while len(chosen) < min(size, len(units)):
        at = int(like.argmin())
        if like[at] >= 1 - SLACK:
            break
        chosen.append(at)
        like = np.maximum(like, units @ units[at])
    return units[chosen]


def _orders(packed: pd.Series) -> np.ndarray:
    """Orders as stored: one row of pivots per vector."""
    return np.frombuffer(b"".join(packed), dtype="<u2").reshape(len(packed), -1)


class Orders:
    """The orders of many vectors, ready for the footrule distance of one query to each."""

    def __init__(self, orders: np.ndarray, pivots: int, posted: int):
        count, self.ranked = orders.shape
        self.pivots, self.posted = pivots, posted
        # ranked for the nearest pivot, down to 1, and 0 for a pivot that is not in the order
        self.weights = np.zeros((count, pivots), dtype=np.int16)
        falling = np.arange(self.ranked, 0, -1, dtype=np.int16)
        np.put_along_axis(self.weights, orders.astype(np.int64), np.broadcast_to(falling, orders.shape), axis=1)

    def sharing(self, order: np.ndarray) -> np.ndarray:
        """Place, in the query's order, of the first posted pivot that each vector is posted under too; `posted` for none."""
        listed = self.weights[:, order[: self.posted]] > self.ranked - self.posted
        return np.where(listed.any(axis=1), listed.argmax(axis=1), self.posted)

    def footrule(self, order: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sum over pivots of how far apart they stand in both orders; a pivot outside an order stands behind its last.

        With weights w = ranked - place, |w - w'| summed is both sums of weights less twice the smaller weights.
        """
        falling = np.arange(self.ranked, 0, -1, dtype=np.int16)
        common = np.minimum(self.weights[np.ix_(rows, order)], falling).sum(axis=1, dtype=np.int64)
        return self.ranked * (self.ranked + 1) - 2 * common

    def levels(self, order: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.footrule(order, rows) * (LEVELS - 1) // (self.ranked * (self.ranked + 1))).astype(np.int32)


def _true_neighbours(index: DataFrame, probes: list, k: int) -> list:
    """(query, rep, order) of the k vectors of largest cosine for each probe, by comparing the probes with all."""
    ids = np.array([p.rep for p in probes], dtype=np.int64)
    units = unit(np.array([p.v for p in probes], dtype=np.float64))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                reps = part["rep"].to_numpy(np.int64)
                scores = units @ unit(np.array(part["v"].tolist(), dtype=np.float64)).T
                scores[ids[:, None] == reps[None, :]] = -np.inf
                keep = min(k, len(reps))
                top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                cols = top.ravel()
                yield pd.DataFrame(
                    {"query": np.repeat(ids, keep), "rep": reps[cols], "ord": part["ord"].to_numpy()[cols], "score": np.take_along_axis(scores, top, 1).ravel()}
                )

    found = index.mapInPandas(best, "query long, rep long, ord binary, score double").filter(F.col("score") > F.lit(float("-inf")))
    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("at", F.row_number().over(nearest_first)).filter(F.col("at") <= k).select("query", "rep", "ord").collect()


class Spread:
    """The orders of a bounded sample of the vectors: how far a query must look to pass `n` of them."""

    def __init__(self, orders: np.ndarray, pivots: int, posted: int):
        self.orders, self.posted = Orders(orders, pivots, posted), posted

    def levels(self, order: np.ndarray) -> np.ndarray:
        """Sorted levels of the sampled vectors that share a file with the query.

        Those of the query's own order are left out: the query itself, and what no distance can tell from it.
        """
        rows = np.flatnonzero(self.orders.sharing(order) < self.posted)
        rows = rows[self.orders.footrule(order, rows) > 0]
        return np.sort(self.orders.levels(order, rows))

    def cut(self, order: np.ndarray, n: int) -> int:
        """Level of the n-th nearest sampled vector; the last level if there are fewer."""
        levels = self.levels(order)
        return int(levels[n - 1]) if n <= len(levels) else LEVELS - 1


def _needed(index: DataFrame, asked: DataFrame, sample: np.ndarray, pivots: int, k: int) -> tuple[int, int]:
    """How many files must list a vector, and how many sampled vectors a query must pass.

    The true neighbours of at most PROBES queries come from comparing these with all
    vectors in blocks. The files are as many as let REACHED of the neighbours meet their
    query; the sampled vectors are as many as stand, by footrule, before RECALL of them.
    """
    ranked = sample.shape[1]
    probes = asked.select("rep").distinct().orderBy(F.xxhash64(F.lit(6), "rep"), "rep").limit(PROBES).join(index, "rep").collect()
    posted = min(POSTED, ranked)
    true = _true_neighbours(index, probes, k) if probes else []
    if not true:
        return posted, 1
    orders = {p.rep: np.frombuffer(p.ord, dtype="<u2") for p in probes}
    of = np.stack([orders[r.query] for r in true])
    theirs = np.stack([np.frombuffer(r.ord, dtype="<u2") for r in true])
    # files needed by a pair: the later of a common pivot's two places, for the common pivot where that is least
    places = np.full((2, len(true), pivots), ranked)
    for side, rows in enumerate((of, theirs)):
        np.put_along_axis(places[side], rows.astype(np.int64), np.broadcast_to(np.arange(ranked), rows.shape), axis=1)
    meet = np.sort(places.max(axis=0).min(axis=1) + 1)
    posted = min(ranked, max(posted, int(meet[math.ceil(REACHED * len(meet)) - 1])))
    spread = Spread(sample, pivots, posted)
    passed = {query: spread.levels(order) for query, order in orders.items()}
    standing = []
    for r, own, other in zip(true, of, theirs):
        pair = Orders(other[None, :], pivots, posted)
        if pair.sharing(own)[0] < posted:
            standing.append(int(np.searchsorted(passed[r.query], pair.levels(own, np.array([0]))[0], "left")) + 1)
    standing.sort()
    return posted, standing[min(len(standing), math.ceil(RECALL * len(true))) - 1] if standing else 1


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """The k vectors of largest cosine found for every query: query_id, rank from 1, vec_id, score.

    queries is a frame of ids of vectors; a vector is no neighbour of itself. Scores
    are cosines in double precision; ties go to the smaller id. NULL, zero, empty or
    non-finite vectors and rows without id take no part, as query or candidate;
    candidates have the query's length; rows of one id are one vector. With fewer
    candidates than k, all reached are returned; an empty table gives an empty result.
    Columns beside id and vector are not read, so their names may clash.

    Every vector is represented by the order in which it sees its RANKED nearest of
    some pivots, chosen far from one another in a sample. Files, one per pivot, list
    the vectors that have it among their first. A query looks into the files of its own
    first pivots and ranks what they list by footrule distance of the orders; all up to
    the query's distance are reranked by cosine. That distance is the one at which the
    query passes a number of sampled vectors. This number, and how many files are needed,
    are read off a bounded set of queries (`_needed`), so the candidates are a share of
    the vectors that the data ask for. Missed are neighbours that share no
    file with the query or stand beyond its distance. Equal vectors are one entry; its
    k + 1 smallest ids stand for it. Files are cut into blocks by a hash, so every block
    holds a fair share.
    """
    whole = usable(vectors, id_col, vector_col)
    wanted = queries.select(F.col(id_col).cast("long").alias("id")).distinct()
    out = vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    for equal in by_length(whole):
        out = out.union(_of_one_length(equal, wanted, k, id_col, pivots, block, sample))
    return out


def _of_one_length(whole: DataFrame, wanted: DataFrame, k: int, id_col: str, pivots: int, block: int, sample: int) -> DataFrame:
    classes = saved(whole.groupBy("v").agg(F.min("id").alias("rep")))
    units = sampled(classes, sample, "rep", "v")
    seen = spread_out(units, max(pivots, math.ceil(math.sqrt(classes.count()) / 4)))
    ranked = min(RANKED, len(seen))
    orders = permutations(units, seen)[:, :ranked]

    def represent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 4096):
                part = batch.iloc[first : first + 4096]
                orders = permutations(unit(np.array(part["v"].tolist(), dtype=np.float64)), seen)[:, :ranked]
                yield part.assign(ord=[row.astype("<u2").tobytes() for row in orders])

    index = saved(classes.mapInPandas(represent, "v array<double>, rep long, ord binary"))
    asked = saved(
        whole.join(wanted, "id", "left_semi").join(classes, "v").select(F.col("id").alias("query"), "rep")
    )
    posted, passing = _needed(index, asked, orders, len(seen), k)
    found = _search(index, asked, orders, len(seen), posted, passing, k + 1, block)
    # the ids of a class, the smallest k + 1 of them
    inside = Window.partitionBy("rep").orderBy("id")
    ids = whole.join(classes, "v").select("rep", "id").withColumn("n", F.row_number().over(inside)).filter(F.col("n") <= k + 1)
    pairs = (
        asked.select(F.col("query").alias("query_id"), F.col("rep").alias("query")).join(found, "query")
        .join(ids.select("rep", F.col("id").alias(id_col)), "rep")
        .filter(F.col("query_id") != F.col(id_col))
    )
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return pairs.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _search(
    index: DataFrame, asked: DataFrame, sample: np.ndarray, pivots: int, posted: int, passing: int, keep: int, block: int
) -> DataFrame:
    """(query, rep, score) of the `keep` best classes found for each asked class.

    Every query has a cut, the level of footrule distance at which it passes `passing` sampled
    vectors. A pair is ranked once, under the first pivot, in the query's order, whose
    file lists both, and scored if its level is within the cut.
    """
    spread = Spread(sample, pivots, posted)

    def cuts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cut=[spread.cut(order, passing) for order in _orders(batch["of_ord"])] if len(batch) else [])

    asking = (
        asked.select("rep").distinct().join(index, "rep")
        .select(F.col("rep").alias("query"), F.col("v").alias("of_v"), F.col("ord").alias("of_ord"))
        .mapInPandas(cuts_of, "query long, of_v array<double>, of_ord binary, cut int")
    )

    def files(order: str):
        def pivot_at(i):  # a place of the order holds two bytes, the low one first
            return F.conv(F.hex(F.concat(F.substring(order, 2 * i + 2, 1), F.substring(order, 2 * i + 1, 1))), 16, 10).cast("int")

        return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(posted - 1)), pivot_at)).alias("place", "pivot")

    listed = index.select("rep", "v", "ord", files("ord"))
    looking = saved(asking).select("*", files("of_ord"))
    sizes = listed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    askers = looking.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns"))
    cuts = saved(sizes.join(askers, "pivot"))
    key = ("pivot", "b", "t")
    left = (
        listed.drop("place").join(cuts, "pivot")
        .withColumn("b", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    )
    right = (
        looking.join(cuts, "pivot")
        .withColumn("t", F.pmod(F.xxhash64(F.lit(4), "query"), F.col("turns")).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )

    def score(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "rep": [], "score": []})]
        if len(entries) and len(queries):
            orders, ids = Orders(_orders(entries["ord"]), pivots, posted), entries["rep"].to_numpy(np.int64)
            units, wanted = unit(np.array(entries["v"].tolist())), unit(np.array(queries["of_v"].tolist()))
            asked_by = zip(queries["query"].tolist(), wanted, _orders(queries["of_ord"]), queries["place"].tolist(), queries["cut"].tolist())
            for query, v, order, place, cut in asked_by:
                rows = np.flatnonzero(orders.sharing(order) == place)
                rows = rows[orders.levels(order, rows) <= cut]
                scores = np.einsum("ij,j->i", units[rows], v)
                best = np.lexsort((ids[rows], -scores))[:keep]
                out.append(pd.DataFrame({"query": query, "rep": ids[rows][best], "score": scores[best]}))
        return pd.concat(out[1:] or out)

    found = (
        left.select(*key, "rep", "v", "ord").groupBy(*key)
        .cogroup(right.select(*key, "query", "of_v", "of_ord", "place", "cut").groupBy(*key))
        .applyInPandas(score, "query long, rep long, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return saved(found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= keep).select("query", "rep", "score"))
