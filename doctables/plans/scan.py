"""Ordered running computations that stay parallel inside one huge group.

A plain window sends a whole group to one task. If one table holds a third of
all rows, that task never ends. Here each group is cut into blocks by a rule on
its order columns (for example `floor(row_idx / 100000)`), the window runs per
block, and only one summary row per block is scanned per group. The carry from
earlier blocks is then joined back on (group, block). With coarser blocks on top
the summaries are scanned the same way.

Blocks must follow the order: sorting by the block columns and then by `order`
has to give the same sequence as sorting by `order`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.plans.durable import durable

BLOCK_ROWS = 100_000


def row_block(column: str, rows: int = BLOCK_ROWS) -> Column:
    """Block number for an integer position column."""
    return F.expr(f"`{column}` div {rows}")


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    block: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    coarse: Sequence[Sequence[Column]] = (),
    rare: bool = False,
) -> DataFrame:
    """Add inclusive running sums and last-non-null values per group.

    `sums` and `lasts` map an output column to the expression it accumulates.
    `coarse` gives blocks of blocks. Group columns must not be NULL. With `rare`, few
    groups if any have several blocks: a job finds them, and only they are summed up.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    levels, columns = [], {}
    for depth, exprs in enumerate([block, *coarse]):
        names = [f"_block{depth}_{i}" for i in range(len(exprs))]
        columns |= dict(zip(names, exprs))
        levels.append(names)
    inputs = {f"_in_{name}": expr for name, expr in {**sums, **lasts}.items()}
    marked = df.withColumns(columns).withColumns(inputs)
    long = None
    if rare:
        long = _long_groups(marked, list(group), levels[0])
        if long.isEmpty():
            levels = []
    done = _scan(marked, list(group), list(order), levels, list(sums), list(lasts), 0, long)
    return (
        done.withColumns(
            {name: F.coalesce(F.col(f"_out_{name}"), F.lit(0)) for name in sums}
            | {name: F.col(f"_out_{name}") for name in lasts}
        )
        .drop(*columns, *inputs, *[f"_out_{name}" for name in [*sums, *lasts]])
    )


def _long_groups(df: DataFrame, group: list[str], block: list[str]) -> DataFrame:
    """Groups with rows in several blocks."""
    ends = df.groupBy(*group).agg(
        *[F.min(n).alias(f"_a{n}") for n in block], *[F.max(n).alias(f"_b{n}") for n in block]
    )
    return durable(ends.filter(" or ".join(f"_a{n} <> _b{n}" for n in block)).select(*group))


def _scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    levels: list[list[str]],
    sums: list[str],
    lasts: list[str],
    end: int,
    long: DataFrame | None = None,
) -> DataFrame:
    """Add `_out_x` from `_in_x`, up to the current row (end 0) or the one before (-1).

    With `long`, only rows of these groups carry something from block to block.
    """
    above = [name for level in levels for name in level]
    keys = [*group, *above]
    values = [*sums, *lasts]
    if levels:
        at = F.struct(*order)
        carrying = df if long is None else df.join(long, group, "left_semi")
        totals = carrying.groupBy(*keys).agg(
            *[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums],
            *[
                F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), at)).alias(f"_in_{n}")
                for n in lasts
            ],
        )
        carried = (
            _scan(totals, group, levels[0], levels[1:], sums, lasts, -1)
            .select(*keys, *[F.col(f"_out_{n}").alias(f"_in_{n}") for n in values])
            .dropna("all", subset=[f"_in_{n}" for n in values])
            .withColumn("_own", F.lit(False))
        )
        df = df.withColumn("_own", F.lit(True)).unionByName(carried, allowMissingColumns=True)
        order = ["_own", *order]

    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    done = df.withColumns(
        {f"_out_{n}": F.sum(f"_in_{n}").over(inside) for n in sums}
        | {f"_out_{n}": F.last(f"_in_{n}", ignorenulls=True).over(inside) for n in lasts}
    )
    return done.filter("_own").drop("_own") if levels else done


def number_rows(
    df: DataFrame,
    order: str,
    name: str,
    start: Column | int = 0,
    block_rows: int = BLOCK_ROWS,
    group: Sequence[str] = (),
) -> DataFrame:
    """Dense numbers `start + 1, start + 2, …` by an integer column, unique per group.

    Works block by block, so no task ever holds the whole frame.
    """
    keys = list(group) or ["_all"]
    tagged = df if group else df.withColumn("_all", F.lit(1))
    numbered = running(
        tagged,
        keys,
        [order],
        [row_block(order, block_rows)],
        sums={name: F.lit(1)},
        coarse=[] if group else [[row_block(order, block_rows * 10_000)]],
    )
    first = start if isinstance(start, Column) else F.lit(start)
    return numbered.withColumn(name, F.col(name) + first).drop("_all")


FAN = 256


def _composed(items: Column, start: Column) -> Column:
    """Table of many tables applied one after the other, to the states in `start`."""
    return F.aggregate(
        items,
        start,
        lambda acc, item: F.transform(
            acc,
            lambda s: F.struct(
                F.get(item["table"], s["at"].cast("int"))["at"].alias("at"),
                (s["n"] + F.get(item["table"], s["at"].cast("int"))["n"]).alias("n"),
            ),
        ),
    )


def _followed(items: Column, start: Column) -> Column:
    """Array of (place, entry, before): the state in which each table is entered, and the count before it."""
    done = F.aggregate(
        items,
        F.struct(start.alias("s"), F.array().cast("array<struct<place: bigint, entry: bigint, before: bigint>>").alias("out")),
        lambda acc, item: F.struct(
            F.struct(
                F.get(item["table"], acc["s"]["at"].cast("int"))["at"].alias("at"),
                (acc["s"]["n"] + F.get(item["table"], acc["s"]["at"].cast("int"))["n"]).alias("n"),
            ).alias("s"),
            F.array_append(
                acc["out"],
                F.struct(item["place"].alias("place"), acc["s"]["at"].alias("entry"), acc["s"]["n"].alias("before")),
            ).alias("out"),
        ),
    )
    return done["out"]


def chained(tables: DataFrame, group: Sequence[str], states: int, levels: int = 2, fan: int = FAN) -> DataFrame:
    """State in which each place of a group is entered, when places are passed in order from state 0.

    `tables`: group, place (from 0), table: for each of the `states` entry states
    (at: state left in, n: what is counted on the way). Applying tables one after the
    other is associative, so `fan` of them in a row are composed to one, and those
    again, `levels` times; from the top the states are then handed down. A task holds
    `fan` tables, and the top only what is left of a group after `levels` steps.
    """
    keys = [*group, "_up"]
    if levels == 0:
        tables = tables.withColumn("_up", F.lit(0).cast("long"))
    else:
        tables = tables.withColumn("_up", F.expr(f"place div {fan}"))
    packed = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "table"))).alias("items"))
    zero = F.lit(0).cast("long")
    if levels == 0:
        entered = packed.withColumns({"entry": zero, "before": zero})
    else:
        start = F.array(*[F.struct(F.lit(e).cast("long").alias("at"), zero.alias("n")) for e in range(states)])
        above = packed.select(*group, F.col("_up").alias("place"), _composed(F.col("items"), start).alias("table"))
        above = chained(above, group, states, levels - 1, fan).withColumnRenamed("place", "_up")
        entered = packed.join(above, keys)
    begin = F.struct(F.col("entry").alias("at"), F.col("before").alias("n"))
    return entered.select(*group, F.inline(_followed(F.col("items"), begin)))
