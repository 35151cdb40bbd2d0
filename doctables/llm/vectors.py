"""What the vector operators share: usable vectors, one row per distinct vector, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.work import saved


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of vectors that take part: with an id, all components finite, not zero.

    Rows of one id are one vector; the smallest in array order stands for it.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        "id is not null and v is not null and size(v) > 0"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    return saved(rows.groupBy("id").agg(F.min("v").alias("v")))


def by_length(whole: DataFrame) -> list[DataFrame]:
    """The usable vectors of each length that at least two of them have, shortest first.

    Cosines are defined within a length only, so each is searched for itself. Lengths
    are as many as the models that made the vectors, not as the rows.
    """
    found = whole.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("n").collect()
    return [whole.filter(F.size("v") == n) for n in sorted(r.n for r in found)]


def sampled(classes: DataFrame, size: int, id_col: str, vector_col: str) -> np.ndarray:
    """At most `size` vectors, the first in a hash of their id, as unit vectors. Bounded by `size`."""
    rows = classes.orderBy(F.xxhash64(F.lit(5), id_col), id_col).limit(size).select(vector_col).collect()
    return unit(np.array([r[0] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component is taken out first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
