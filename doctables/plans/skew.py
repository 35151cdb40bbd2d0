"""Keys that hold too many rows for one task or one output cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.plans.scan import row_block, running

MAX_ITEMS = 100_000


def with_parts(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    max_items: int = MAX_ITEMS,
    name: str = "part",
) -> DataFrame:
    """Add the column `name`: the slice of its key that a row falls in, from 0 on without gaps.

    `position` is an integer that orders the rows and is unique within a key. Every
    key is cut by the same rule, whatever its size: rows are numbered by position,
    and each `max_items` of them make a slice. Grouping by (key, slice) then bounds
    every list, and no row is lost. Rows with a NULL key belong to nothing and go.
    """
    numbered = running(
        df.dropna("any", subset=list(keys)),
        list(keys),
        [position],
        [row_block(position, max_items)],
        sums={"_number": F.lit(1)},
        coarse=[[row_block(position, max_items * 10_000)]],
    )
    return numbered.withColumn(name, F.expr(f"cast((_number - 1) div {max_items} as int)")).drop("_number")


def spread_nulls(key: Column, row: Column, ways: int = 256) -> Column:
    """Second join key that spreads NULL keys over tasks; 0 for all real keys.

    A NULL key never matches, but an outer join still sends all of them to one
    partition. The other side joins on a literal 0.
    """
    return F.when(key.isNull(), F.pmod(F.xxhash64(row), F.lit(ways))).otherwise(F.lit(0))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key by `order`; NULL keys are equal to each other.

    Row-number = 1 is turned into a group limit before the shuffle, so a hot key
    sends one row per map task and not its whole group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int
) -> DataFrame:
    """First `k` rows of every key by `order`, pruned before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= k).drop("_n")


def last_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the last by `order`, which is dropped; without it the greatest by its values.

    An aggregation with partial results, so a key with very many rows is no burden.
    """
    packed = F.struct(*[c for c in df.columns if c not in (key, order)])
    chosen = F.max(packed) if order is None else F.max_by(packed, order)
    return df.groupBy(key).agg(chosen.alias("_row")).select(key, "_row.*")
