"""Tables that run over several pages: find the parts and join them.

Which table a part belongs to depends on the header of the table it would
continue, so the decision is a fold over the tables of a document. It runs on
one row per physical table. Long documents are cut into blocks of pages, each
block is folded on its own, and the blocks are folded again only while the
header that enters one of them still changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.functions.similarity import header_text
from doctables.operators.tables import fitted, is_noise, merge_marked, merged_lines, starts_record
from doctables.model import TABLE
from doctables.plans.durable import durable
from doctables.plans.scan import row_block

SAME_HEADERS = 0.75
REPEATED_HEADER = 0.80
BLOCK_PAGES = 2_000

KNOWN = 100_000

_STATE = "master_page int, master_index int, master_headers string, master_columns int"
_STATE_COLUMNS = ["master_page", "master_index", "master_headers", "master_columns"]
_EXIT_COLUMNS = ["doc_id", "block", *_STATE_COLUMNS]
_FOLD_COLUMNS = [
    "doc_id", "block", "page", "table_index", "headers", "first_row", "columns", *_STATE_COLUMNS,
]


def _alike(left: str | None, right: str | None, limit: float, known: dict) -> bool:
    """Whether the similarity of two lists (JSON) is above the limit; cheap upper bounds come first."""
    if left is None or right is None:
        return False
    key = (left, right, limit)
    if key not in known:
        if len(known) >= KNOWN:
            known.clear()
        known[key] = False
        text = _text(right)
        matcher = SequenceMatcher(None, _text(left))
        # Upper bounds that need no index of the second text: its length, and its letters that the first has too.
        size = len(matcher.a) + len(text)
        if not size or (
            2.0 * min(len(matcher.a), len(text)) / size > limit
            and 2.0 * sum(map(frozenset(matcher.a).__contains__, text)) / size > limit
        ):
            matcher.set_seq2(text)
            known[key] = matcher.quick_ratio() > limit and matcher.ratio() > limit
    return known[key]


@lru_cache(maxsize=10_000)
def _text(cells: str) -> str:
    return header_text([c or "" for c in json.loads(cells)])


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Fold rows sorted by (doc_id, block, page, table_index), batch by batch.

    Yields (doc, block, page, index, master page, master index, headers, columns,
    repeated) per table. Only the current table, and whether some pairs of headers
    are alike, is kept between batches.
    """
    place, master, known = None, None, {}
    for batch in batches:
        out = []
        for doc, block, page, index, headers, row, columns, *entry in zip(
            *(batch[c].tolist() for c in _FOLD_COLUMNS)
        ):
            if (doc, block) != place:
                place = (doc, block)
                master = None if pd.isna(entry[0]) else (int(entry[0]), int(entry[1]), entry[2], int(entry[3]))
            repeated = joined = False
            if master is not None:
                repeated = _alike(master[2], row, REPEATED_HEADER, known)
                bare = headers is None and columns == master[3]
                joined = repeated or bare or _alike(master[2], headers, SAME_HEADERS, known)
            if not joined:
                master = (page, index, headers, columns)
            out.append((doc, block, page, index, *master, repeated))
        yield out


def _in_order(blocks: DataFrame) -> DataFrame:
    """Blocks spread over all tasks, each whole and in order in one of them."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "doc_id", "block").sortWithinPartitions(
        "doc_id", "block", "page", "table_index"
    )


def _exits(blocks: DataFrame) -> DataFrame:
    """State that leaves each block: the table that its last table belongs to."""

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = None
        for rows in _folded(batches):
            done = []
            for row in rows:
                if end is not None and row[:2] != end[:2]:
                    done.append((*end[:2], *end[4:8]))
                end = row
            yield pd.DataFrame(done, columns=_EXIT_COLUMNS)
        if end is not None:
            yield pd.DataFrame([(*end[:2], *end[4:8])], columns=_EXIT_COLUMNS)

    doc = blocks.schema["doc_id"].dataType.simpleString()
    return _in_order(blocks).mapInPandas(last, f"doc_id {doc}, block bigint, {_STATE}")


def _entries(exits: DataFrame, *more: str) -> DataFrame:
    """State that enters each block: the exit of the block before it."""
    window = Window.partitionBy("doc_id").orderBy("block")
    state = F.struct(*_STATE_COLUMNS, *more)
    return (
        exits.select("doc_id", "block", F.lag(state).over(window).alias("_in"))
        .filter(F.col("_in").isNotNull())
        .select("doc_id", "block", "_in.*")
    )


def table_heads(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per physical table: headers, first row and width, and more aggregates."""
    heads = rows.groupBy(*TABLE).agg(
        F.min_by("headers", "row_idx").alias("headers"),
        F.min_by("cells", "row_idx").alias("first_row"),
        F.min("row_idx").alias("first_idx"),
        *more,
    )
    width = F.when(F.size("headers") > 0, F.size("headers")).otherwise(F.size("first_row"))
    return heads.withColumn("columns", F.coalesce(width, F.lit(0)))


def assign_masters(heads: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Table each physical table belongs to, and whether its first row repeats the header.

    Runs jobs for documents longer than one block, none of which reads data rows.
    """
    empty = [F.lit(None).cast(t).alias(n) for n, t in (p.split(" ") for p in _STATE.split(", "))]
    doc = heads.schema["doc_id"].dataType.simpleString()
    # Lists go to Python as one text each, NULL for none; every pass reads this table.
    text = lambda c: F.when(F.size(c) > 0, F.to_json(c)).alias(c)
    blocks = durable(
        heads.select(
            "doc_id", "page", "table_index", text("headers"), text("first_row"), "columns",
            F.expr(f"page div {block_pages}").alias("block"),
        )
    )
    long = (
        blocks.groupBy("doc_id")
        .agg(F.min("block").alias("a"), F.max("block").alias("b"))
        .filter("a < b")
        .select("doc_id")
    )
    entries = None
    if not long.isEmpty():
        cut = durable(blocks.join(long, "doc_id", "left_semi"))
        exits = durable(_exits(cut.select("*", *empty)).withColumn("_moved", F.lit(True)))
        while True:
            # A block is folded again only if the state that enters it has changed.
            todo = _entries(exits, "_moved").filter("_moved").drop("_moved")
            again = _exits(cut.join(todo, ["doc_id", "block"])).select("doc_id", "block", F.struct(*_STATE_COLUMNS).alias("_new"))
            later = exits.drop("_moved").join(again, ["doc_id", "block"], "left")
            moved = F.expr("_new.master_page <> master_page or _new.master_index <> master_index")
            state = [F.when(F.col("_new").isNull(), F.col(n)).otherwise(F.col("_new")[n]).alias(n) for n in _STATE_COLUMNS]
            exits = durable(later.select("doc_id", "block", *state, F.coalesce(moved, F.lit(False)).alias("_moved")))
            if exits.filter("_moved").isEmpty():
                break
        entries = _entries(exits)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "page", "table_index", "master_page", "master_index", "columns", "drop_first"]
        for rows in _folded(batches):
            picked = [(r[0], r[2], r[3], r[4], r[5], r[7], r[8]) for r in rows]
            yield pd.DataFrame(picked, columns=names)

    entered = (
        blocks.select("*", *empty)
        if entries is None
        else blocks.join(entries, ["doc_id", "block"], "left")
    )
    return _in_order(entered).mapInPandas(
        assign,
        f"doc_id {doc}, page int, table_index int, master_page int, master_index int, "
        "columns int, drop_first boolean",
    )


def _outline(rows: DataFrame) -> DataFrame:
    """`table_heads` with the first and last row that starts a record and the last that continues one, noise left out."""
    kept = ~F.coalesce(is_noise(F.col("cells")), F.lit(True))
    kind = F.when(kept, starts_record(F.col("cells")))
    starts, continues = F.when(F.col("_kind"), F.col("row_idx")), F.when(~F.col("_kind"), F.col("row_idx"))
    return table_heads(
        rows.withColumn("_kind", kind),
        F.min(starts).alias("first_start"),
        F.max(starts).alias("last_start"),
        F.max(continues).alias("last_more"),
    )


def _reaching(parts: DataFrame, block_pages: int) -> DataFrame:
    """Add `_open` and `_tail`: records of a physical table that may reach over its ends.

    A table is open as a whole if its first row that is left may continue a record
    above, if none of its rows starts one, or if it is longer than a block of rows.
    Its last record is open if the next table of the master is, or lies in another
    block of pages. In doubt a record counts as open: that costs time and no more.
    """
    after = lambda name: F.when(F.col("drop_first"), F.col(name) > F.col("first_idx")).otherwise(F.col(name).isNotNull())
    starts, continues = F.coalesce(after("last_start"), F.lit(False)), F.coalesce(after("last_more"), F.lit(False))
    leads = continues & (F.col("drop_first") | F.coalesce(F.col("first_start") > F.col("first_idx"), F.lit(True)))
    long = row_block("first_idx") < row_block("last_idx")
    in_order = Window.partitionBy("doc_id", F.expr(f"page div {block_pages}")).orderBy("page", "table_index")
    follows = F.lead(F.struct("master_page", "master_index", "_open")).over(in_order)
    same = (F.col("_next.master_page") == F.col("master_page")) & (F.col("_next.master_index") == F.col("master_index"))
    return (
        parts.withColumn("_open", ~starts | leads | long)
        .withColumn("_next", follows)
        .withColumn("_tail", F.coalesce(same & F.col("_next._open"), F.lit(True)))
        .drop("_next")
    )


def stitch_tables(rows: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Join the parts of tables that run over pages and heal their rows as one table.

    Runs jobs over one row per physical table. Most records lie within one physical
    table and are put together there; only those that may reach over its ends are
    numbered and grouped by the whole table. Result: doc_id, master_page, master_index, and page, table_index, row_idx of the
    first source row, headers of the master, cells.
    """
    # One row per physical table, read by every step but the last.
    heads = durable(_outline(rows))
    masters = assign_masters(heads, block_pages)
    names = heads.select(
        "doc_id",
        F.col("page").alias("master_page"),
        F.col("table_index").alias("master_index"),
        F.col("headers").alias("headers"),
    )
    ends = heads.select(*TABLE, "first_idx", "first_start", "last_start", "last_more").withColumn(
        "last_idx", F.greatest("first_idx", "last_start", "last_more")
    )
    known = _reaching(masters.join(ends, TABLE), block_pages).join(names, ["doc_id", "master_page", "master_index"])
    # A long table has a row per block of rows, so that no task gets all of its rows.
    parts = durable(
        known.withColumn("_piece", F.explode(F.sequence(row_block("first_idx"), row_block("last_idx")))).select(
            *TABLE, "_piece", "master_page", "master_index", "headers", F.col("columns").alias("_columns"),
            F.when(F.col("drop_first"), F.col("first_idx")).alias("_dropped"),
            "_open", F.when(F.col("_tail"), F.col("last_start")).alias("_from"), F.col("last_more").isNotNull().alias("_wraps"),
        )
    )
    piece, master = [*TABLE, "_piece"], ["doc_id", "master_page", "master_index"]
    # Whether a row starts a record is told after the shuffle, so that all branches read the same one.
    body = (
        rows.drop("headers")
        .filter(~is_noise(F.col("cells")))
        .withColumn("_piece", row_block("row_idx"))
    )
    start = starts_record(F.col("cells"))
    left = ~F.coalesce(F.col("row_idx") == F.col("_dropped"), F.lit(False))
    reaches = F.coalesce(F.col("row_idx") >= F.col("_from"), F.lit(False))
    carried = [c for c in ("headers", "method", "confidence") if c == "headers" or c in rows.columns]
    result = [*master, "page", "table_index", "row_idx", "cells", *carried]

    in_order = Window.partitionBy(*piece).orderBy("row_idx")
    alone = start & (F.col("_next").isNull() | starts_record(F.col("_next")))
    record = F.sum(F.col("_start").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    single = (
        body.withColumn("_next", F.lead("cells").over(in_order))
        .filter(alone)
        .join(parts.filter("not _open"), piece)
        .filter(left & ~reaches)
        .withColumn("cells", fitted(F.col("cells"), F.col("_columns")))
    )
    # Few parts have wrapped rows or open ends: they are looked up, and rows of others go before any sort.
    wrapped = (
        body.join(parts.filter("not _open and _wraps").hint("shuffle_hash"), piece)
        .withColumn("_start", start)
        .withColumns({"_record": record, "_next": F.lead("cells").over(in_order)})
        .filter(~alone)
        .filter(left & ~reaches)
    )
    open_ends = body.join(parts.filter("_open or _from is not null").hint("shuffle_hash"), piece).filter(
        left & (F.col("_open") | reaches)
    )
    across = merge_marked(
        open_ends.withColumn("_start", start),
        master,
        ["page", "table_index", "row_idx"],
        [F.col("page"), F.col("table_index"), row_block("row_idx")],
        [[row_block("page", 4096)]],
    )
    inside = merged_lines(wrapped, [*piece, "master_page", "master_index", "_record"], ["row_idx"])
    return single.select(*result).unionByName(inside.select(*result)).unionByName(across.select(*result))
