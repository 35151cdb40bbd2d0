"""Page and document statistics, sections, running heads, continuation groups.

`pages`: doc_id, page (from 1), text, images, drawings, tables (NULL when the
table finder was not run), and for the layout functions width and height.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions.text import SPACE, is_blank, strip
from doctables.model import TABLE
from doctables.plans.scan import row_block, running
from doctables.plans.skew import top_per_key


def word_count(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, rf"(?U){SPACE}+")))


def page_stats(pages: DataFrame) -> DataFrame:
    """Text length, words, images, scan and vector marks, table count, sample."""
    text = F.coalesce("text", F.lit(""))
    measured = pages.withColumns(
        {"text_length": F.length(strip(text)), "word_count": word_count(text)}
    )
    guessed = (F.col("drawings") > 8) & (F.col("word_count") > 15)
    return measured.select(
        "doc_id",
        "page",
        "text_length",
        "word_count",
        F.col("images").alias("image_count"),
        ((F.col("text_length") < 40) & (F.col("images") > 0)).alias("is_scanned"),
        (F.col("drawings") > 0).alias("has_vectors"),
        F.coalesce("tables", guessed.cast("int")).alias("table_count"),
        strip(F.replace(F.substring(text, 1, 200), F.lit("\n"), F.lit(" "))).alias("sample"),
    )


def document_rollup(stats: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Document scores from the statistics of all its pages, or of the first `max_pages` if the caller says so."""
    seen = F.lit(True) if max_pages is None else F.col("page") <= max_pages

    def total(value: Column) -> Column:
        return F.sum(F.when(seen, value).otherwise(F.lit(0)))

    rolled = stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(seen).alias("_seen"),
        total(F.col("text_length")).alias("total_text_length"),
        total(F.col("image_count")).alias("total_images"),
        total(F.col("is_scanned").cast("int")).alias("_scanned"),
        total(F.col("table_count")).alias("_tables"),
    )

    def share(value: Column) -> Column:
        return F.bround(F.when(F.col("_seen") > 0, value).otherwise(F.lit(0.0)), 2)

    return rolled.select(
        "doc_id",
        "page_count",
        "total_text_length",
        "total_images",
        share(F.col("_scanned") / F.col("_seen")).alias("scanned_ratio"),
        share(
            F.least(F.lit(1.0), F.col("total_text_length") / F.col("_seen") / F.lit(300.0))
        ).alias("text_availability"),
        share(F.least(F.lit(1.0), F.col("_tables") / F.col("_seen"))).alias("table_likelihood"),
        (F.col("total_text_length") > 100).alias("has_digital_text"),
    )


def layout_stats(pages: DataFrame) -> DataFrame:
    """Text density per page: characters per 10 000 square points."""
    chars = F.length(F.coalesce("text", F.lit("")))
    area = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    return pages.select(
        "doc_id",
        "page",
        chars.alias("char_count"),
        (chars > 50).alias("has_text"),
        ((F.col("images") > 0) & (chars < 60)).alias("is_scanned"),
        F.bround(chars / area * 10000, 2).alias("text_density"),
    )


def layout_rollup(stats: DataFrame) -> DataFrame:
    """Document density and scan mark (more than half of its pages)."""
    return stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.bround(F.avg("text_density"), 2).alias("text_density_avg"),
        (F.count_if("is_scanned") > F.count(F.lit(1)) * 0.5).alias("is_scanned"),
    )


def running_heads(blocks: DataFrame, keep: int = 2) -> DataFrame:
    """First short text blocks in the top and bottom 12 % of each page.

    `blocks`: doc_id, page, block_no, y0, y1, text, height (of the page).
    """
    text = strip(F.col("text"))
    zone = F.when(F.col("y1") <= F.col("height") * 0.12, "header").when(
        F.col("y0") >= F.col("height") * 0.88, "footer"
    )
    marked = blocks.select(
        "doc_id",
        "page",
        "block_no",
        zone.alias("zone"),
        F.replace(text, F.lit("\n"), F.lit(" ")).alias("text"),
    ).filter(F.col("zone").isNotNull() & F.length("text").between(1, 119))
    return top_per_key(marked, ["doc_id", "page", "zone"], ["block_no"], keep)


def sections(pages: DataFrame, lines: int | None = None, keep: int | None = None) -> DataFrame:
    """Headings of all pages; of the first `lines` of a page and the first `keep` of a document if the caller says so."""
    head = F.split(F.coalesce("text", F.lit("")), "\n")
    head = head if lines is None else F.slice(head, 1, lines)
    title = strip(F.col("line"))
    found = (
        pages.select("doc_id", "page", F.posexplode(head).alias("line_no", "line"))
        .select("doc_id", "page", "line_no", title.alias("title"))
        .filter(F.length("title").between(5, 79))
        .filter(
            ((F.upper("title") == F.col("title")) & (F.lower("title") != F.col("title")))
            | F.col("title").rlike("^(SECTION|TABLE|ANNEXURE)")
        )
    )
    kind = (
        F.when(F.col("title").contains("ANNEXURE"), "annexure")
        .when(F.col("title").contains("TABLE"), "dataset")
        .otherwise("body")
    )
    if keep is not None:
        found = top_per_key(found, ["doc_id"], ["page", "line_no"], keep)
    return found.withColumn("section_type", kind)


def table_inventory(rows: DataFrame) -> DataFrame:
    """Tables per page: id, headers and estimated rows (all rows but the first)."""
    return rows.groupBy(*TABLE).agg(
        F.format_string("tab_p%d_%d", F.col("page"), F.col("table_index") + 1).alias("table_id"),
        F.min_by("cells", "row_idx").alias("headers"),
        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("row_estimate"),
    )


def linked_pages(tables: DataFrame) -> DataFrame:
    """Pages that a table of the page before seems to run into.

    `tables`: doc_id, page, table_index, headers, row_estimate. The last table of a
    page and the first of the next are linked when their headers agree (equal, or
    equally many) or both have more than five rows. `above` is the number of tables
    on the page before.
    """
    ends = tables.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("headers", "row_estimate"), "table_index").alias("_top"),
        F.max_by(F.struct("headers", "row_estimate"), "table_index").alias("_bottom"),
    )
    before = ends.select(
        "doc_id", (F.col("page") + 1).alias("page"), F.col("_bottom"), F.col("_n").alias("_above")
    )
    up, down = F.col("_bottom"), F.col("_top")
    agree = (
        (F.size(up["headers"]) > 0)
        & (F.size(down["headers"]) > 0)
        & (F.size(up["headers"]) == F.size(down["headers"]))
    ) | ((up["row_estimate"] > 5) & (down["row_estimate"] > 5))
    return (
        ends.drop("_bottom", "_n")
        .join(before, ["doc_id", "page"])
        .filter(agree)
        .select("doc_id", "page", F.col("_above").alias("above"))
    )


def continuation_groups(tables: DataFrame, page_block: int = 4096) -> DataFrame:
    """Runs of linked pages, as intervals.

    A run goes on through a page only if the page has a single table.
    """
    links = linked_pages(tables)
    previous = links.select("doc_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("_linked"))
    starts = links.join(previous, ["doc_id", "page"], "left").withColumn(
        "_start", (F.col("_linked").isNull() | (F.col("above") > 1)).cast("long")
    )
    return (
        running(
            starts, ["doc_id"], ["page"], [row_block("page", page_block)],
            sums={"group_no": F.col("_start")},
        )
        .groupBy("doc_id", "group_no")
        .agg((F.min("page") - 1).alias("first_page"), F.max("page").alias("last_page"))
    )


def continued_pages(groups: DataFrame) -> DataFrame:
    """Pages of the groups but their first: those a table runs into."""
    # Two steps bound the arrays, however long a run is.
    step = 10_000
    spans = groups.select(
        "doc_id",
        "last_page",
        F.explode(F.sequence(F.col("first_page") + 1, F.col("last_page"), F.lit(step))).alias("_from"),
    )
    end = F.least("last_page", F.col("_from") + (step - 1))
    return spans.select("doc_id", F.explode(F.sequence("_from", end)).alias("page")).distinct()


def select_documents(df: DataFrame, document_ids: Sequence | DataFrame) -> DataFrame:
    """Rows of the chosen documents only."""
    if isinstance(document_ids, DataFrame):
        return df.join(document_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return df.filter(F.col("doc_id").isin(list(document_ids)))


def select_pages(df: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Rows of the chosen pages; numbers below 1 select nothing."""
    return df.filter(F.col("page").isin([p for p in wanted if p > 0]))


def page_preview(pages: DataFrame, first: int = 5, chars: int = 300) -> DataFrame:
    """Preview of the first pages."""
    text = F.coalesce("text", F.lit(""))
    return pages.filter(F.col("page") <= first).select(
        "doc_id",
        "page",
        F.length(text).alias("char_count"),
        F.substring(text, 1, chars).alias("preview"),
        F.coalesce("tables", F.lit(0)).alias("table_count"),
    )


def preview_rollup(preview: DataFrame) -> DataFrame:
    return preview.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_previewed"),
        F.sum("table_count").alias("table_count"),
        F.bool_or(F.col("char_count") > 0).alias("has_text_layer"),
    )


def intake_sample(pages: DataFrame) -> DataFrame:
    """What is kept of a document's first page when it arrives."""
    text = F.coalesce("text", F.lit(""))
    return pages.filter("page = 1").select(
        "doc_id",
        F.substring(text, 1, 2000).alias("sample_text"),
        F.substring(text, 1, 400).alias("preview"),
        (~is_blank(text)).alias("has_text_layer"),
    )
