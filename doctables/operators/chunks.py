"""Page chunks for later reading, with overlap inside continued tables.

A chunk starts where the one before it ends, one page earlier if that end lies
in a continued table. The start of a chunk thus depends on all earlier ones. A
block of pages is summed up as "where the next chunk starts, for each place the
first may start". Such tables are composed in a tree (`plans.scan.chained`), the entry of
each block is handed down, and all blocks are then filled in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions.text import strip
from doctables.plans.durable import durable
from doctables.plans.scan import chained, number_rows

BLOCK_PAGES = 1024


def _follow(steps: Column, entry: int) -> Column:
    """Follow the steps through one block: first start behind it, starts in it."""
    begin = F.struct(F.lit(entry).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        steps,
        begin,
        lambda acc, s: F.when(
            acc["at"] == s["i"],
            F.struct((acc["at"] + s["step"]).alias("at"), (acc["n"] + 1).alias("n")),
        ).otherwise(acc),
    )


def place_pages(pages: DataFrame) -> DataFrame:
    """Position of every page among the distinct pages of its document, from 0."""
    distinct = pages.select("doc_id", "page").distinct()
    return number_rows(distinct, "page", "pos", start=-1, block_rows=4096, group=["doc_id"])


def chunk_starts(
    placed: DataFrame, continued: DataFrame | None, size: int = 4, block: int = BLOCK_PAGES
) -> DataFrame:
    """Positions at which chunks start: doc_id, start, chunk_index.

    `placed`: doc_id, page, pos. `continued`: doc_id, page of pages a table runs into.
    Runs a job over page numbers.
    """
    counts = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pages"))
    steps = placed.join(counts, "doc_id").select(
        "doc_id", "pos", "_pages", F.lit(size).cast("long").alias("step")
    )
    if continued is not None:
        short = placed.join(continued, ["doc_id", "page"], "left_semi").select(
            "doc_id", (F.col("pos") - (size - 1)).alias("pos"), F.lit(True).alias("_short")
        )
        steps = (
            steps.drop("step")
            .join(short, ["doc_id", "pos"], "left")
            .withColumn(
                "step",
                F.when(
                    F.col("_short") & (F.col("pos") + size < F.col("_pages")), max(1, size - 1)
                )
                .otherwise(size)
                .cast("long"),
            )
        )
    # Read at every level of the tree and by the last step: written once.
    blocks = durable(
        steps.withColumn("block", F.expr(f"pos div {block}"))
        .groupBy("doc_id", "block")
        .agg(
            F.array_sort(
                F.collect_list(F.struct((F.col("pos") % block).alias("i"), "step"))
            ).alias("steps"),
        )
    )
    # a state is the position, within a block, at which the first chunk in it starts
    left = [_follow(F.col("steps"), e) for e in range(size)]
    exits = blocks.select(
        "doc_id",
        F.col("block").alias("place"),
        F.array(
            *[F.struct(F.greatest(out["at"] - block, F.lit(0).cast("long")).alias("at"), out["n"].alias("n")) for out in left]
        ).alias("table"),
    )
    entries = chained(exits, ["doc_id"], size).withColumnsRenamed({"place": "block", "before": "first"})
    found = F.aggregate(
        "steps",
        F.struct(F.col("entry").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, s: F.struct(
            F.when(acc["at"] == s["i"], acc["at"] + s["step"]).otherwise(acc["at"]).alias("at"),
            F.when(acc["at"] == s["i"], F.array_append(acc["starts"], s["i"]))
            .otherwise(acc["starts"])
            .alias("starts"),
        ),
    )["starts"]
    starts = blocks.join(entries, ["doc_id", "block"]).select(
        "doc_id", "block", "first", F.posexplode(found).alias("_n", "_i")
    )
    return starts.select(
        "doc_id",
        (F.col("block") * block + F.col("_i")).alias("start"),
        (F.col("first") + F.col("_n")).alias("chunk_index"),
    )


def create_chunks(
    pages: DataFrame,
    continued: DataFrame | None = None,
    size: int = 4,
    wanted: DataFrame | None = None,
    overlap_lines: int = 15,
    block: int = BLOCK_PAGES,
    texts: bool = True,
) -> DataFrame:
    """Chunks of `size` pages with their text and the context before them.

    `pages`: doc_id, page, text. `continued`: doc_id, page of pages a table runs into
    (`pages.linked_pages`, or `pages.continued_pages` of stored groups). `wanted`:
    doc_id, page of the pages to take (all without it). Without `texts` the chunks have
    no text, and the texts of their pages are not moved. Runs jobs over page numbers.
    """
    chosen = pages if wanted is None else pages.join(wanted, ["doc_id", "page"], "left_semi")
    # Two narrow tables of page numbers feed every step below: write them once.
    placed = durable(place_pages(chosen))
    if continued is not None:
        continued = durable(continued.select("doc_id", "page").distinct())
    starts = chunk_starts(placed, continued, size, block)
    members = starts.select(
        "doc_id", "chunk_index", F.explode(F.sequence("start", F.col("start") + size - 1)).alias("pos")
    ).join(placed, ["doc_id", "pos"])
    parts = [
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.array_sort(F.collect_list("page")).alias("pages"),
    ]
    if texts:
        shown = F.format_string("=== PAGE %d ===\n%s", F.col("page"), F.coalesce("text", F.lit("")))
        members = members.join(chosen.select("doc_id", "page", "text"), ["doc_id", "page"]).withColumn("_shown", shown)
        parts.append(F.expr("listagg(_shown, '\n\n') within group (order by page)").alias("text"))
    chunks = members.groupBy("doc_id", "chunk_index").agg(*parts)
    if continued is None:
        return chunks.withColumns(
            {"is_continuation": F.lit(False), "overlap": F.lit(None).cast("string")}
        )
    marks = continued.select(
        "doc_id", F.col("page").alias("page_start"), F.lit(True).alias("is_continuation")
    )
    before = pages.select(
        "doc_id",
        (F.col("page") + 1).alias("page_start"),
        last_lines(F.col("text"), overlap_lines).alias("_before"),
    )
    return (
        chunks.join(marks, ["doc_id", "page_start"], "left")
        .withColumn("is_continuation", F.coalesce("is_continuation", F.lit(False)))
        .join(before, ["doc_id", "page_start"], "left")
        .withColumn("overlap", F.when(F.col("is_continuation"), F.col("_before")))
        .drop("_before")
    )


def last_lines(text: Column, count: int = 15) -> Column:
    """Last non-blank lines of a text; NULL when it has none."""
    lines = F.filter(F.split(text, "\n"), lambda line: strip(line) != "")
    tail = F.slice(
        lines,
        F.greatest(F.size(lines) - F.lit(count - 1), F.lit(1)),
        F.lit(count),
    )
    return F.when(F.size(lines) > 0, F.array_join(tail, "\n"))


def cache_key(
    document_hash: Column,
    start: Column,
    end: Column,
    model: Column,
    version: Column,
    profile: Column | None = None,
) -> Column:
    """Key of a reusable chunk result."""
    parts = [document_hash, start, end, model, version, F.lit("default") if profile is None else profile]
    return F.sha2(F.concat_ws("_", *[p.cast("string") for p in parts]), 256)


def cache_misses(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Work without a cached result."""
    return work.join(cache.select(key), key, "left_anti")


def cache_merge(cache: DataFrame, fresh: DataFrame, key: str = "cache_key") -> DataFrame:
    """Cache with fresh results, which replace those of the same key."""
    kept = cache.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
