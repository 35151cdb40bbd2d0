"""Multi-value cells: split, stitch, clean and deduplicate inside one array value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.text import SPACE, strip, strip_chars


def _filled(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda item: item != "")


def split_items(text: Column, delimiter: str = ";") -> Column:
    """Items of a delimited cell: by `delimiter`, else by line, else by comma."""
    body = strip(text)
    return (
        F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>"))
        .when(text.contains(delimiter), _filled(F.split(text, f"\\Q{delimiter}\\E")))
        .when(text.contains("\n"), _filled(F.split(text, "\n")))
        .when(text.contains(","), _filled(F.split(text, ",")))
        .otherwise(F.array(body))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once, so that a lambda can use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stitch_lines(lines: Column) -> Column:
    """Glue wrapped lines to the item above them.

    Whether a line is glued depends on it and on the end of the line above, so
    one pass marks each line with a blank or a line break and splits again.
    """

    def mark(bound: Column) -> Column:
        def joint(line: Column, i: Column) -> Column:
            lower = F.lower(line)
            above = F.try_element_at(bound, i)
            glued = lower.isin(*fixed.GLUE_WORDS)
            for prefix in fixed.GLUE_PREFIXES:
                glued = glued | lower.startswith(prefix)
            glued = glued | above.endswith(",") | above.endswith("-")
            return F.concat(F.when((i > 0) & glued, " ").otherwise("\n"), line)

        return F.transform(bound, joint)

    joined = F.array_join(let(lines, mark), "")
    return F.when(F.size(lines) > 0, F.split(F.substr(joined, F.lit(2)), "\n")).otherwise(
        F.array().cast("array<string>")
    )


def unify_separators(text: Column) -> Column:
    """Line breaks and bullets become `; `."""
    marked = strip(F.regexp_replace(text, r"[\r\n•·]+", "; "))
    return F.regexp_replace(marked, r"\s*;\s*", "; ")


def stitch_cell(text: Column) -> Column:
    """A cell with wrapped list lines as `item; item`."""
    lines = _filled(F.split(F.regexp_replace(text, r"[•·]+", "; "), r"[\r\n]+"))
    joined = F.array_join(stitch_lines(lines), "; ")
    return strip_chars(F.regexp_replace(joined, r"\s*;\s*", "; "), " ;")


def distinct_ignoring_case(items: Column) -> Column:
    """Drop repeats by lower case; the first spelling and the order stay."""
    tagged = F.array_sort(
        F.transform(
            items,
            lambda item, i: F.struct(F.lower(item).alias("key"), i.alias("i"), item.alias("item")),
        )
    )
    firsts = let(
        tagged,
        lambda rows: F.filter(
            rows, lambda row, i: (i == 0) | (row["key"] != F.try_element_at(rows, i)["key"])
        ),
    )
    ordered = F.array_sort(F.transform(firsts, lambda row: F.struct(row["i"], row["item"])))
    return F.transform(ordered, lambda row: row["item"])


def clean_items(items: Column) -> Column:
    """Strip bullets and numbering; drop short items and stop words."""
    bare = F.transform(
        items,
        lambda item: strip_chars(F.regexp_replace(item, rf"(?U){SPACE}+", " "), " \t\r\n;,•·-"),
    )
    useful = F.filter(
        bare, lambda item: (F.length(item) >= 3) & ~F.lower(item).isin(*fixed.LIST_STOPWORDS)
    )
    unnumbered = F.transform(
        useful, lambda item: strip(F.regexp_replace(item, r"^\d+[\.\)]\s*", ""))
    )
    return F.filter(
        unnumbered, lambda item: (item != "") & ~F.lower(item).isin(*fixed.LIST_STOPWORDS)
    )


def clean_list(text: Column) -> Column:
    """Names in a list cell: split, stitch wrapped lines, clean, drop repeats."""
    body = strip(text)
    items = (
        F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>"))
        .when(body.contains(";"), F.split(body, ";"))
        .when(body.rlike("[•·]"), F.split(body, "[•·]+"))
        .when(body.contains("\n"), stitch_lines(_filled(F.split(body, r"\r\n|\r|\n"))))
        .otherwise(F.array(body))
    )
    return distinct_ignoring_case(clean_items(items))
