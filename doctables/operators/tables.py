"""Table reconstruction: raw rows in, clean rows out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.lists import let, stitch_cell, unify_separators
from doctables.functions.text import SPACES, strip, strip_chars
from doctables.model import TABLE
from doctables.plans.scan import row_block, running


FILLED = "[^" + "".join(rf"\x{{{ord(c):X}}}" for c in SPACES) + "]"


def shortest(words: Sequence[str]) -> list[str]:
    """Words without those that contain another one: to contain them implies it."""
    return [w for w in dict.fromkeys(words) if not any(o in w for o in words if o != w)]


def any_of(words: Sequence[str]) -> str:
    """Pattern that finds any of the words as plain text."""
    return "|".join(re.escape(word) for word in shortest(words))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """The same test for a text that costs nothing to read again."""
    hit = F.lit(False)
    for word in shortest(words):
        hit = hit | text.contains(word)
    return hit


def cell(cells: Column, position: int, default: str = "") -> Column:
    """Cell by position from 0, or the default in a short row."""
    return F.coalesce(F.try_element_at(cells, F.lit(position + 1)), F.lit(default))


def strip_cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: strip(F.coalesce(c, F.lit(""))))


def has_text(cells: Column) -> Column:
    """Any cell holds more than white space; one search that ends at the first such character."""
    return F.array_join(cells, "").rlike(FILLED)


def clean_cells(rows: DataFrame) -> DataFrame:
    """Line breaks and tabs to blanks, strip, NULL to ''; rows without text go."""
    cleaned = F.transform(
        "cells", lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n\t]+", " "))
    )
    return rows.filter(has_text(F.col("cells"))).withColumn("cells", cleaned)


def promote_headers(
    rows: DataFrame, table: Sequence[str] = TABLE, min_rows: int = 1
) -> DataFrame:
    """The first row of each table becomes `headers`; the others stay as data."""
    heads = rows.groupBy(*table).agg(
        F.min("row_idx").alias("_first"),
        F.min_by("cells", "row_idx").alias("_headers"),
        F.count(F.lit(1)).alias("_rows"),
    )
    kept = [c for c in rows.columns if c != "headers"]
    return (
        rows.select(*kept)
        .join(heads.filter(F.col("_rows") >= min_rows), list(table))
        .filter(F.col("row_idx") > F.col("_first"))
        .withColumnRenamed("_headers", "headers")
        .drop("_first", "_rows")
    )


def match_headers(headers: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Positions of the headers that name the fields, in field order; -1 for none.

    Fields take their turn in the given order, each takes the first header that
    contains one of its aliases, and no header serves two fields.
    """
    names = F.transform(headers, lambda h: F.lower(strip(h)))

    def named(words: Sequence[str]) -> Column:
        return F.transform(names, lambda name: contains_any(name, words))

    hits = F.array(*[named(words) for words in aliases.values()])

    def take(places: Column, hit: Column) -> Column:
        free = F.transform(hit, lambda x, i: x & ~F.array_contains(places, i))
        return F.array_append(places, F.array_position(free, F.lit(True)).cast("int") - 1)

    return F.aggregate(hits, F.array().cast("array<int>"), take)


def find_header_rows(
    rows: DataFrame,
    aliases: Mapping[str, Sequence[str]],
    table: Sequence[str] = TABLE,
    within: int = 3,
    min_fields: int = 2,
) -> DataFrame:
    """Header row of each table (first of its first three that names two fields).

    `places` holds the column of each field, in the order of `aliases`.
    """
    # One look at the whole row spares data rows the work per cell: a header holds words of enough fields.
    held = lambda row: sum((contains_any(row, words).cast("int") for words in aliases.values()), F.lit(0))
    near = (F.col("row_idx") < within) & (let(F.lower(F.array_join("cells", "\n")), held) >= min_fields)
    heads = rows.filter(near).select(
        *table, "row_idx", match_headers(F.col("cells"), aliases).alias("places")
    )
    named = F.size(F.filter("places", lambda place: place >= 0)) >= min_fields
    # Choosing inside the aggregate, not by a filter, matches every row once.
    at = F.when(named, F.col("row_idx"))
    return (
        heads.groupBy(*table)
        .agg(F.min(at).alias("header_row"), F.min_by("places", at).alias("places"))
        .filter(F.col("header_row").isNotNull())
    )


def project_fields(
    rows: DataFrame,
    aliases: Mapping[str, Sequence[str]],
    defaults: Mapping[str, str],
    header_words: Sequence[str],
    required: Sequence[str],
    min_cells: int,
    table: Sequence[str] = TABLE,
) -> DataFrame:
    """Rows to named columns, by the header row if there is one, else by position.

    Rows above and at the header, blank rows and repeated headers are dropped.
    """
    fields = list(aliases)
    heads = find_header_rows(rows, aliases, table)
    first = F.lower(F.get("cells", F.lit(0)))
    body = (
        rows.filter(has_text(F.col("cells")))
        .filter(~F.coalesce(first.rlike(any_of(header_words)), F.lit(False)))
        .join(heads, list(table), "left")
        .filter(F.col("header_row").isNull() | (F.col("row_idx") > F.col("header_row")))
    )
    mapped = F.lit(True)
    for field in required:
        mapped = mapped & (F.col("places")[fields.index(field)] >= 0)
    by_position = F.array(*[F.lit(i) for i in range(len(fields))])
    placed = body.filter(F.coalesce(mapped, F.lit(False)) | (F.size("cells") >= min_cells)).withColumn(
        "places", F.when(mapped, F.col("places")).otherwise(by_position)
    )
    columns = {}
    for i, field in enumerate(fields):
        found = F.get("cells", F.col("places")[i])
        default = defaults.get(field, "")
        if default:
            there = F.col("places")[i].between(0, F.size("cells") - 1)
            found = F.coalesce(found, F.when(there, "").otherwise(default))
        columns[field] = strip(F.coalesce(found, F.lit("")))
    return placed.withColumns(columns).drop("header_row", "places")


def qualification_rows(
    rows: DataFrame, table: Sequence[str] = TABLE, wrapped_names: bool = False
) -> DataFrame:
    """Qualification lists: named columns, unified separators, wrapped rows merged.

    With `wrapped_names`, a list line that only completes a name ("College") is
    joined to the line above it and is no item of its own.
    """
    items = stitch_cell if wrapped_names else unify_separators
    projected = project_fields(
        rows,
        fixed.QUALIFICATION_ALIASES,
        fixed.QUALIFICATION_DEFAULTS,
        fixed.QUALIFICATION_HEADER_WORDS,
        ("saqa_id", "qualification"),
        4,
        table,
    ).withColumn("participating_colleges", items(F.col("participating_colleges")))
    return merge_wrapped(
        projected,
        fields=list(fixed.QUALIFICATION_ALIASES),
        starts=F.col("saqa_id").rlike(r"\d{4,7}"),
        continues=~F.col("saqa_id").rlike(r"\d{3,}"),
        text="qualification",
        items="participating_colleges",
        table=table,
        glue_fragments=wrapped_names,
    )


def occupation_rows(rows: DataFrame, table: Sequence[str] = TABLE) -> DataFrame:
    """Occupation lists: named columns, wrapped titles merged, other rows dropped."""
    projected = project_fields(
        rows,
        fixed.OCCUPATION_ALIASES,
        fixed.OCCUPATION_DEFAULTS,
        fixed.OCCUPATION_HEADER_WORDS,
        ("ofo_code", "occupation_title"),
        3,
        table,
    )
    return merge_wrapped(
        projected,
        fields=list(fixed.OCCUPATION_ALIASES),
        starts=F.col("ofo_code").rlike(r"^\d{4,6}$"),
        continues=(F.col("ofo_code") == "") & (F.col("occupation_title") != ""),
        text="occupation_title",
        table=table,
    )


def merge_wrapped(
    rows: DataFrame,
    fields: Sequence[str],
    starts: Column,
    continues: Column,
    text: str,
    items: str | None = None,
    table: Sequence[str] = TABLE,
    glue_fragments: bool = False,
) -> DataFrame:
    """Merge continuation rows into the record above them.

    A row starts a record, continues one or is dropped. Continuations append
    their `text` with a blank and their `items` with "; "; with `glue_fragments`,
    an item that only completes a name ("College …") is appended with a blank.
    Continuations above the first record of a table are dropped.
    """
    carried = [c for c in ("method", "confidence") if c in rows.columns]
    kinds = (
        rows.select(*table, "row_idx", *fields, *carried)
        .withColumn("_start", starts)
        .filter(F.col("_start") | continues)
    )
    marked = running(
        kinds,
        table,
        ["row_idx"],
        [row_block("row_idx")],
        sums={"_record": F.col("_start").cast("long")},
    ).filter("_record > 0")

    lists = {text: F.lit(" ")}
    if items:
        fragment = F.lower(F.col(items)).isin(*fixed.GLUE_WORDS) | F.lower(F.col(items)).startswith(
            "college"
        )
        lists[items] = (
            F.when(fragment, " ").otherwise("; ") if glue_fragments else F.lit("; ")
        )
    tokens = {
        f"_token_{name}": F.when(
            F.col(name) != "",
            F.when(F.col("_start"), F.col(name)).otherwise(F.concat(joint, F.col(name))),
        )
        for name, joint in lists.items()
    }
    others = [f for f in fields if f not in lists]
    merged = (
        marked.withColumns(tokens)
        .groupBy(*table, "_record")
        .agg(
            F.min("row_idx").alias("row_idx"),
            F.count(F.lit(1)).alias("_rows"),
            *[F.min_by(c, "row_idx").alias(c) for c in [*others, *carried]],
            *[
                F.expr(f"listagg(_token_{name}, '') within group (order by row_idx)").alias(name)
                for name in lists
            ],
        )
    )
    wrapped = F.col("_rows") > 1
    shown = {text: F.when(wrapped, strip(F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit("")))}
    if items:
        plain = F.coalesce(items, F.lit(""))
        shown[items] = F.when(wrapped, strip_chars(plain, "; ")).otherwise(plain)
    return merged.withColumns(shown).select(*table, "row_idx", *fields, *carried)


def codebook_rows(rows: DataFrame, table: Sequence[str] = TABLE) -> DataFrame:
    """Codebook tables: carry merged variable and label cells down the table.

    Row 0 of a table is its header. Rows of four and more cells are full,
    rows of two or three hold a further value and its label.
    """
    body = rows.filter(
        (F.col("row_idx") > 0) & (F.size("cells") >= 2) & has_text(F.col("cells"))
    )
    full = F.size("cells") >= 4
    filled = fill_down(body, full, table)
    text = lambda i, default="": strip(F.coalesce(cell(F.col("cells"), i, default), F.lit("")))
    at = lambda i, default="": F.when(full, text(i, default))
    return (
        filled.filter(full | F.col("variable_name").isNotNull())
        .select(
            *table,
            "row_idx",
            F.coalesce("variable_name", F.lit("")).alias("variable_name"),
            F.coalesce("variable_label", F.lit("")).alias("variable_label"),
            F.coalesce(at(2), text(0)).alias("value"),
            F.coalesce(at(3), text(1)).alias("value_label"),
            F.coalesce(at(4, "categorical"), F.lit("categorical")).alias("data_type"),
            F.coalesce(at(5), F.lit("")).alias("description"),
        )
    )


def fill_down(rows: DataFrame, full: Column, table: Sequence[str] = TABLE) -> DataFrame:
    """Last non-blank first and second cell of the full rows, down each table."""
    first = F.nullif(strip(cell(F.col("cells"), 0)), F.lit(""))
    second = F.nullif(strip(cell(F.col("cells"), 1)), F.lit(""))
    return running(
        rows,
        table,
        ["row_idx"],
        [row_block("row_idx")],
        lasts={
            "variable_name": F.when(full, first),
            "variable_label": F.when(full, second),
        },
        rare=True,
    )


def delimited_lines(lines: DataFrame, page: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Codebook rows from text lines with pipes or tabs.

    `lines`: page keys, line_no, line. Four parts make a full row; fewer parts
    with a number first continue the variable above.
    """
    parts = F.filter(
        F.transform(F.split("line", r"[|\t]"), strip), lambda part: part != ""
    )
    split = lines.withColumn("cells", parts).withColumnRenamed("line_no", "row_idx")
    full = F.size("cells") >= 4
    wanted = split.filter(
        full | ((F.size("cells") >= 2) & F.get("cells", F.lit(0)).rlike("^[0-9]+$"))
    )
    filled = fill_down(wanted, full, page)
    return filled.filter(F.col("variable_name").isNotNull()).select(
        *page,
        F.lit(0).alias("table_index"),
        "row_idx",
        "variable_name",
        "variable_label",
        F.when(full, cell(F.col("cells"), 2)).otherwise(cell(F.col("cells"), 0)).alias("value"),
        F.when(full, cell(F.col("cells"), 3)).otherwise(cell(F.col("cells"), 1)).alias("value_label"),
        F.lit("categorical").alias("data_type"),
        F.lit("").alias("description"),
    )


def is_noise(cells: Column) -> Column:
    """Blank rows, page numbers, source and note lines."""
    joined = F.array_join(cells, " ")
    # Plain tests come first: few rows begin as a pattern does or hold its slash.
    likely = joined.contains("/") | F.substring(strip(joined), 1, 1).isin("", *"PpSsNnCc")
    text = strip(F.lower(joined))
    # The patterns of page numbers and of source, note and continuation lines.
    return likely & (
        (text == "")
        | text.rlike(r"(?U)^(page\s+\d+(\s+of\s+\d+)?|\d+\s*/\s*\d+)$")
        | text.rlike(r"(?U)^(source\s*:|note\s*:|continued\s+on\s+next\s+page)")
    )


def starts_record(cells: Column) -> Column:
    """Whether a row starts a record; one with a blank first cell and other text continues the row above."""
    first_blank = strip(F.get(cells, F.lit(0))) == ""
    others = F.array_join(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), "")
    return F.coalesce(~((F.size(cells) > 1) & first_blank & (others != "")), F.lit(False))


_CARRIED = ("headers", "method", "confidence")


def heal_rows(
    rows: DataFrame,
    columns: Column,
    table: Sequence[str] = TABLE,
    order: Sequence[str] = ("row_idx",),
    block: Sequence[Column] | None = None,
    coarse: Sequence[Sequence[Column]] = (),
) -> DataFrame:
    """Drop noise rows and merge wrapped rows, cell by cell, into the row above.

    A row with a blank first cell and other text continues the row above; the
    first row of a table never does. Other rows are padded or cut to `columns`.
    """
    kept = rows.filter(~is_noise(F.col("cells"))).withColumns(
        {"_start": starts_record(F.col("cells")), "_columns": columns}
    )
    return merge_marked(kept, table, order, block, coarse)


def merge_marked(
    kept: DataFrame,
    table: Sequence[str],
    order: Sequence[str],
    block: Sequence[Column] | None = None,
    coarse: Sequence[Sequence[Column]] = (),
) -> DataFrame:
    """`heal_rows` for rows without noise that have `_start` and `_columns`."""
    marked = running(
        kept,
        table,
        order,
        block or [row_block("row_idx")],
        sums={"_record": F.col("_start").cast("long")},
        coarse=coarse,
        rare=block is None,
    )
    return merged_lines(marked, [*table, "_record"], order).select(
        *dict.fromkeys([*table, *order]), "cells", *[c for c in _CARRIED if c in kept.columns]
    )


def fitted(cells: Column, columns: Column) -> Column:
    """Cells of a record of one line, padded or cut; blank ones are ''."""
    given = F.transform(
        F.slice(cells, F.lit(1), F.greatest(columns, F.lit(0))), lambda c: F.when(strip(c) != "", c).otherwise("")
    )
    return F.concat(given, F.array_repeat(F.lit(""), F.greatest(columns - F.size(given), F.lit(0))))


def merged_lines(marked: DataFrame, record: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per record from its rows in order: the place of the first, cells padded or cut to its `_columns`."""
    carried = [c for c in _CARRIED if c in marked.columns]
    records = marked.groupBy(*record).agg(
        F.min(F.struct(*order)).alias("_at"),
        F.min_by("_columns", F.struct(*order)).alias("_columns"),
        *[F.min_by(c, F.struct(*order)).alias(c) for c in carried],
        F.array_sort(F.collect_list(F.struct(*order, "cells"))).alias("_lines"),
    )

    def merged(i: Column) -> Column:
        texts = F.transform(F.col("_lines"), lambda line: F.try_element_at(line["cells"], i))
        joined = F.array_join(
            F.filter(texts, lambda text: text.isNotNull() & (strip(text) != "")), " "
        )
        return F.when(F.size("_lines") > 1, strip(joined)).otherwise(joined)

    cells = F.when(
        F.col("_columns") > 0, F.transform(F.sequence(F.lit(1), F.greatest("_columns", F.lit(1))), merged)
    ).otherwise(F.array().cast("array<string>"))
    return records.select(
        *record, *[F.col("_at")[c].alias(c) for c in order if c not in record], cells.alias("cells"), *carried
    )


def records_by_position(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Named columns by position; missing cells are ''."""
    return rows.withColumns(
        {field: cell(F.col("cells"), i) for i, field in enumerate(fields)}
    ).drop("cells")


def with_fallback(special: DataFrame, generic: DataFrame) -> DataFrame:
    """Rows of the special reader, and generic rows of the documents it found nothing in."""
    found = special.select("doc_id").distinct()
    return special.unionByName(generic.join(found, "doc_id", "left_anti"), allowMissingColumns=True)


def extraction_quality(
    rows: DataFrame, by: Sequence[str] = ("doc_id", "method"), table: Sequence[str] = TABLE
) -> DataFrame:
    """Score of an extraction: mean over its tables of width, completeness and content.

    `headers` gives the expected width of a table; without it its first row does.
    """
    text_of = lambda c: strip(F.coalesce(c, F.lit("")))
    measured = rows.select(
        *dict.fromkeys([*by, *table]),
        "row_idx",
        F.size("cells").alias("_width"),
        F.coalesce(F.nullif(F.size("headers"), F.lit(0)), F.lit(-1)).alias("_head")
        if "headers" in rows.columns
        else F.lit(-1).alias("_head"),
        F.size(F.filter("cells", lambda c: text_of(c) == "")).alias("_empty"),
        F.size(F.filter("cells", lambda c: F.length(text_of(c)) > 1)).alias("_content"),
    )
    keys = list(dict.fromkeys([*by, *table]))
    widths = measured.groupBy(*keys, "_width", "_head").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_empty").alias("_empty"),
        F.sum("_content").alias("_content"),
        F.min("row_idx").alias("_first"),
    )
    # One row per width: the expected width is known only after the first row is.
    tables = (
        widths.groupBy(*keys)
        .agg(
            F.when(F.max("_head") > 0, F.max("_head"))
            .otherwise(F.min_by("_width", "_first"))
            .alias("_expected"),
            F.sum("_rows").alias("_rows"),
            F.sum("_empty").alias("_empty"),
            F.sum("_content").alias("_content"),
            F.collect_list(F.struct("_width", "_rows")).alias("_widths"),
        )
        .filter("_expected > 0")
    )
    total = F.col("_rows") * F.col("_expected")
    consistent = F.aggregate(
        F.filter("_widths", lambda w: w["_width"] == F.col("_expected")),
        F.lit(0).cast("long"),
        lambda acc, w: acc + w["_rows"],
    )
    score = (
        consistent / F.col("_rows") * 0.40
        + F.greatest(F.lit(0.0), 1 - F.col("_empty") / total * 1.2) * 0.35
        + F.least(F.lit(1.0), F.col("_content") / total) * 0.25
    )
    return (
        tables.withColumn("_score", score)
        .groupBy(*by)
        .agg(F.bround(F.avg("_score"), 2).alias("quality"), F.count(F.lit(1)).alias("tables"))
    )


def best_strategy(
    scores: DataFrame,
    primary: Column,
    candidates: Sequence[str] = ("pdf_pymupdf", "pdf_tables", "pdf_text"),
    enough: float = 0.65,
    fallback: bool = True,
) -> DataFrame:
    """Strategy per document: the first good enough, else the best, ties to the earlier.

    `scores`: doc_id, strategy, quality. A strategy without a row scored nothing.
    """
    place = F.when(F.col("strategy") == primary, 0)
    for i, name in enumerate(candidates, 1):
        place = place.when(F.col("strategy") == name, i)
    tried = scores.withColumn("_place", place).filter(
        F.col("_place").isNotNull() if fallback else F.col("_place") == 0
    )
    good = F.col("quality") >= enough
    rank = F.struct(
        F.when(good, 0).otherwise(1).alias("a"),
        F.when(good, F.col("_place")).otherwise(0).alias("b"),
        (-F.col("quality")).alias("c"),
        F.col("_place").alias("d"),
    )
    return tried.groupBy("doc_id").agg(
        F.min_by("strategy", rank).alias("strategy"), F.min_by("quality", rank).alias("quality")
    )


def require_rows(rows: DataFrame) -> DataFrame:
    """Fail when no table was found. Runs a job that reads one row."""
    if rows.isEmpty():
        raise ValueError("no table rows in the input")
    return rows
