"""Near-duplicate vectors by an inverted multi-index: a grid of cells from two codebooks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.vectors import by_length, sampled, unit, usable
from doctables.llm.work import components, saved

COSINE = 0.9
SAMPLE = 16_384  #: vectors that the codebooks are fitted on and that are compared with all others; the bound of what the driver reads
LARGEST_BOOK = 256
LEAST_CELLS = 100  #: cells with linked vectors of the sample below which no reach is read off a part of the vectors
MARGIN = 1.25  #: what is searched beyond the sample's farthest link, where the sample is a part
RECALL = 0.999
BLOCK = 512  #: vectors of a cell compared at once
WHOLE_BLOCK = 2048  #: and where all are compared with all
STEPS = 256
SAME = 1 - 1e-12  #: cosine from which two vectors have one direction: a vector and itself, or its multiples


def codebook(points: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """Centres of the points by Lloyd's rounds from evenly spaced points in order of their projection."""
    points = np.unique(points, axis=0)
    size = min(size, len(points))
    spread = np.argsort(points @ np.cos(np.arange(points.shape[1])), kind="stable")
    centres = points[spread[np.linspace(0, len(points) - 1, size).astype(int)]].copy()
    for _ in range(rounds):
        nearest = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        count = np.bincount(nearest, minlength=size)
        centres[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


class Grid:
    """Cells (i, j): vectors whose first half is nearest to centre i, the second to centre j."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def excess(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per half, how much farther each centre is than the nearest."""
        half = self.first.shape[1]
        a, b = _distances(units[:, :half], self.first), _distances(units[:, half:], self.second)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)

    def home(self, units: np.ndarray) -> np.ndarray:
        a, b = self.excess(units)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def visits(self, units: np.ndarray, reach: float) -> list[np.ndarray]:
        """Cells of each vector in order of a^2 + b^2, up to reach^2, by the multi-sequence walk.

        Both lists of excesses are sorted; a row of the product grid is entered only
        as far as its sums stay within the reach, so the walk sees no other cells.
        """
        first, second = self.excess(units)
        out = []
        for a, b in zip(first * first, second * second):
            rows, cols = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            left = reach * reach - a[rows]
            depth = np.searchsorted(b[cols], left[left >= 0], "right")
            row = np.repeat(np.arange(len(depth)), depth)
            col = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
            cells = rows[row] * len(self.second) + cols[col]
            out.append(cells[np.argsort(a[rows[row]] + b[cols[col]], kind="stable")].astype(np.int32))
        return out


def proven_reach(cosine: float) -> float:
    """Excess within which every vector of this cosine lies, by the triangle inequality: 2 |x - y|."""
    return 2 * math.sqrt(max(0.0, 2 - 2 * cosine))


def needed_reach(classes: DataFrame, grid: Grid, probes: np.ndarray, cosine: float, recall: float, whole: bool) -> float | None:
    """Excess that finds `recall` of the links of each probe; None if they show too few links to tell.

    The probes are compared with all vectors in blocks. A probe's match with itself is
    no link. Every probe counts alone, so a large group of near copies does not decide
    for the others. Where the probes are the whole of the vectors, nothing is unseen;
    otherwise linked probes must lie in LEAST_CELLS cells. Links are counted by probe
    and step of excess, and one number per linked probe comes back.
    """
    top = proven_reach(cosine)
    first, second = grid.excess(probes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(len(probes) * (STEPS + 1), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                units = unit(np.array(batch["v"].iloc[at : at + 256].tolist(), dtype=np.float64))
                home = grid.home(units)
                dots = probes @ units.T
                p, x = np.nonzero((dots >= cosine) & (dots < SAME))
                i, j = home[x] // len(grid.second), home[x] % len(grid.second)
                need = np.sqrt(first[p, i] ** 2 + second[p, j] ** 2)
                steps = np.minimum(np.ceil(need / top * STEPS), STEPS).astype(np.int64)
                np.add.at(seen, p * (STEPS + 1) + steps, 1)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"probe": at // (STEPS + 1), "step": at % (STEPS + 1), "n": seen[at]})

    counted = classes.select("v").mapInPandas(count, "probe int, step int, n long").groupBy("probe", "step").agg(F.sum("n").alias("n"))
    upto, everything = Window.partitionBy("probe").orderBy("step"), Window.partitionBy("probe")
    needed = (
        counted.withColumns({"found": F.sum("n").over(upto), "links": F.sum("n").over(everything)})
        .filter(F.col("found") >= F.lit(recall) * F.col("links"))
        .groupBy("probe")
        .agg(F.min("step").alias("step"))
    )
    steps = dict(needed.collect())
    if not whole and len(set(grid.home(probes[list(steps)]).tolist()) if steps else ()) < LEAST_CELLS:
        return None
    return min(top, top * max(steps.values(), default=0) / STEPS * (1.0 if whole else MARGIN))


def _compare(cosine: float, home: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    """Links of one block of a cell with one block of its visitors: counts, and links that keep them connected."""
    h, v = unit(np.array(home["v"].tolist())), unit(np.array(visitors["of_v"].tolist()))
    hid, vid = home["rep"].to_numpy(np.int64), visitors["of_rep"].to_numpy(np.int64)
    i, j = np.nonzero(v @ h.T >= cosine)
    other = vid[i] != hid[j]
    i, j = i[other], j[other]
    hn, vn = home["n"].to_numpy(np.int64), visitors["of_n"].to_numpy(np.int64)
    # a home vector that does not visit the visitor's cell learns of the link here
    back = np.ones(len(i), dtype=bool)
    by_home = np.argsort(j, kind="stable")
    visited, cells = home["cells"].tolist(), visitors["of_home"].to_numpy(np.int32)
    for part in np.split(by_home, np.flatnonzero(np.diff(j[by_home])) + 1) if len(i) else []:
        back[part] = ~np.isin(cells[i[part]], visited[j[part[0]]])
    found = np.zeros(len(vid), dtype=np.int64)
    np.add.at(found, i, hn[j])
    learnt = np.zeros(len(hid), dtype=np.int64)
    np.add.at(learnt, j[back], vn[i[back]])
    # smallest id connected within this block
    lowest_v, lowest_h = vid.copy(), hid.copy()
    while len(i):
        before = lowest_v.sum() + lowest_h.sum(), lowest_v.copy(), lowest_h.copy()
        np.minimum.at(lowest_h, j, lowest_v[i])
        np.minimum.at(lowest_v, i, lowest_h[j])
        if (lowest_v == before[1]).all() and (lowest_h == before[2]).all():
            break
    ids = np.concatenate((vid, hid))
    out = pd.DataFrame({"rep": ids, "links": np.concatenate((found, learnt)), "low": np.concatenate((lowest_v, lowest_h))})
    return out[(out["links"] > 0) | (out["low"] != out["rep"])]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
    recall: float = RECALL, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors whose cosine is at least `cosine` are linked; n_links counts the other
    vectors linked directly, component_id is the smallest id reachable by links, kept
    marks it. NULL, zero, empty or non-finite vectors link with nothing: no links, their
    own component, kept. Vectors link within their length only. A row without id has no links, no component and is not kept. Rows of one id are one
    vector. An empty table gives an empty result.

    Equal vectors are one class. Two codebooks, one per half, are fitted on a sample
    of at most `sample` vectors; every class has one cell of the product grid, visits
    the nearest cells as far as `recall` of the links of every sampled vector needs, and
    is verified against their members by exact cosine in blocks. If the sample shows too
    few links to tell, all are compared with all: the grid is then one cell. Blocks give counts and a few
    links per vector, never all pairs. Cells of any size are cut into blocks. What the
    search can miss are links whose cells both vectors leave out; none found is wrong.
    """
    whole = usable(vectors, id_col, vector_col)
    everyone = vectors.select(F.col(id_col).cast("long").alias("id"))
    of = vectors.sparkSession.createDataFrame([], "id long, links long, component long")
    for equal in by_length(whole):
        of = of.union(_of_one_length(equal, cosine, recall, block, sample))
    return (
        everyone.join(of, "id", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )


def _of_one_length(whole: DataFrame, cosine: float, recall: float, block: int, sample: int) -> DataFrame:
    """(id, links, component) of all vectors of one length."""
    classes = saved(whole.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    count = classes.count()
    size = max(2, min(LARGEST_BOOK, math.ceil(math.sqrt(count / 16))))
    probes = sampled(classes, sample, "rep", "v")
    half = max(1, probes.shape[1] // 2)
    second = probes[:, half:]  # empty if vectors have one number
    grid = Grid(codebook(probes[:, :half], size), codebook(second, size) if second.shape[1] else np.zeros((1, 0)))
    reach = needed_reach(classes, grid, probes, cosine, recall, count <= sample)
    if reach is None:
        grid, reach, block = Grid(grid.first[:1], grid.second[:1]), 0.0, max(block, WHOLE_BLOCK)
    found = _linked(classes, grid, reach, cosine, block)
    return whole.join(classes, "v").select("id", "rep", "n").join(found, "rep", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )


def _linked(classes: DataFrame, grid: Grid, reach: float, cosine: float, block: int) -> DataFrame:
    """(rep, links, component) of classes (rep, n, v) that link with another class."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                units = unit(np.array(part["v"].tolist(), dtype=np.float64))
                yield part.assign(home=grid.home(units).astype(np.int32), cells=grid.visits(units, reach))

    placed = saved(
        classes.select("rep", "n", "v").mapInPandas(place, "rep long, n long, v array<double>, home int, cells array<int>")
    )
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("hb"))
    guests = (
        placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("vb"))
    )
    cuts = saved(homes.join(guests, "cell"))
    own, other = F.xxhash64(F.lit(1), "rep"), F.xxhash64(F.lit(2), "rep")
    left = (
        placed.withColumnRenamed("home", "cell").join(cuts, "cell")
        .withColumn("h", F.pmod(own, F.col("hb")).cast("int"))
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
        .select("cell", "h", "g", "rep", "n", "v", "cells")
    )
    right = (
        placed.select("rep", "n", "v", "home", F.explode("cells").alias("cell")).join(cuts, "cell")
        .withColumn("g", F.pmod(other, F.col("vb")).cast("int"))
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)))
        .select("cell", "h", "g", *[F.col(c).alias(f"of_{c}") for c in ("rep", "n", "v", "home")])
    )

    def compare(key, home: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if not len(home) or not len(visitors):
            return pd.DataFrame({"rep": [], "links": [], "low": []}).astype("int64")
        return _compare(cosine, home, visitors)

    results = saved(
        left.groupBy("cell", "h", "g")
        .cogroup(right.groupBy("cell", "h", "g"))
        .applyInPandas(compare, "rep long, links long, low long")
    )
    together = components(results.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = results.groupBy("rep").agg(F.sum("links").alias("links"))
    return saved(
        counts.join(together, counts.rep == together.node, "left").select("rep", "links", F.coalesce("component", "rep").alias("component"))
    )
