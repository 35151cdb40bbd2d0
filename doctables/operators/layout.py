"""Tables from word positions: text layout and OCR word tables.

A line of words becomes one row of cells, so a line is the largest group that
any step holds; pages and documents are only aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.functions.text import is_blank
from doctables.plans.durable import durable

PAGE = ["doc_id", "page"]
CUT = "\x1f"


def text_lines(words: DataFrame, page: Sequence[str] = PAGE, gap: float = 18.0) -> DataFrame:
    """Words to lines of cells: y within 4 points is one line, a wide gap starts a cell.

    `words`: page keys, word_no, x0, x1, y0, word.
    """
    keys = [*page, "line_y"]
    placed = words.withColumn("line_y", (F.bround(F.col("y0") / 4.0) * 4).cast("int"))
    lines = placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("x0", "word_no", "x1", "word"))).alias("_words")
    )

    def token(w, i):
        before = F.when(i > 0, F.get("_words", i - 1)["x1"])
        cut = (before > 0) & (w["x0"] - before > gap)
        return F.when(before.isNull(), w["word"]).otherwise(
            F.concat(F.when(cut, CUT).otherwise(" "), w["word"])
        )

    tokens = F.transform("_words", token)
    line = F.when(F.exists("_words", lambda w: w["word"].isNotNull()), F.array_join(tokens, ""))
    return lines.select(*keys, F.split(line, CUT).alias("cells"))


def text_tables(words: DataFrame, page: Sequence[str] = PAGE, gap: float = 18.0) -> DataFrame:
    """One table per page from word positions.

    Lines of two and more cells count; the usual cell count sets the width, lines
    that differ from it by more than one are dropped, the first line is the header.
    Runs a job that puts words together to lines.
    """
    # Read by both steps below: written once, so that no task sorts words twice.
    lines = durable(
        text_lines(words, page, gap)
        .withColumn("_n", F.size("cells"))
        .filter("_n >= 2")
    )
    counts = lines.groupBy(*page, "_n").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.min("line_y").alias("_y"),
        F.min_by("cells", "line_y").alias("_cells"),
    )
    widths = counts.groupBy(*page).agg(
        F.max_by("_n", F.struct("_lines", -F.col("_n"))).alias("_width"),
        F.collect_list(F.struct("_y", "_n", "_lines", "_cells")).alias("_by_n"),
    )
    near = F.filter("_by_n", lambda c: F.abs(c["_n"] - F.col("_width")) <= 1)
    heads = (
        widths.withColumn("_near", F.array_sort(near))
        .withColumn(
            "_aligned", F.aggregate("_near", F.lit(0).cast("long"), lambda a, c: a + c["_lines"])
        )
        .filter("_aligned >= 2")
        .select(
            *page,
            "_width",
            F.col("_near")[0]["_y"].alias("_head_y"),
            _fit(F.col("_near")[0]["_cells"]).alias("headers"),
        )
    )
    return (
        lines.join(heads, list(page))
        .filter((F.abs(F.col("_n") - F.col("_width")) <= 1) & (F.col("line_y") > F.col("_head_y")))
        .select(
            *page,
            F.lit(0).alias("table_index"),
            F.col("line_y").alias("row_idx"),
            "headers",
            _fit(F.col("cells")).alias("cells"),
            F.lit("pdf_text").alias("method"),
            F.lit(0.75).alias("confidence"),
        )
    )


def _fit(cells):
    """Pad with '' or cut to the width of the page."""
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.col("_width")))
    return F.slice(padded, F.lit(1), F.col("_width"))


def ocr_tables(words: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """One table per page from an OCR word table.

    `words`: page keys, block_num, line_num, left, word_no, text. Words of a line
    become its cells; lines of one word are dropped; the first line is the header.
    """
    line = [*page, "block_num", "line_num"]
    lines = (
        words.filter(~is_blank(F.col("text")))
        .groupBy(*line)
        .agg(F.array_sort(F.collect_list(F.struct("left", "word_no", "text"))).alias("_words"))
        .filter(F.size("_words") >= 2)
        .select(*line, F.transform("_words", lambda w: w["text"]).alias("cells"))
    )
    spot = F.struct("block_num", "line_num")
    heads = (
        lines.groupBy(*page)
        .agg(
            F.count(F.lit(1)).alias("_lines"),
            F.min(spot).alias("_head"),
            F.min_by("cells", spot).alias("headers"),
        )
        .filter("_lines >= 2")
        .drop("_lines")
    )
    return (
        lines.join(heads, list(page))
        .filter(spot > F.col("_head"))
        .select(
            *page,
            F.lit(0).alias("table_index"),
            "block_num",
            "line_num",
            "headers",
            "cells",
            F.lit("ocr").alias("method"),
            F.lit(0.70).alias("confidence"),
        )
    )
