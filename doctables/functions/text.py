"""String functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctables.functions import fixed

# Unicode white space, plus the four ASCII separators.
SPACE = r"[\s\x{1C}-\x{1F}]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def strip_chars(text: Column, chars: str) -> Column:
    """Remove any of `chars` at both ends."""
    return F.btrim(text, F.lit(chars))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; ends are stripped."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def is_blank(text: Column) -> Column:
    """NULL, empty or white space only. Never NULL itself."""
    return F.coalesce(strip(text.cast("string")) == "", F.lit(True))


def nullify(text: Column) -> Column:
    """Blank text becomes NULL, other text is stripped."""
    stripped = strip(text.cast("string"))
    return F.when(stripped != "", stripped)


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, by the ICU library that Spark ships."""
    return F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )


def clean_unicode(text: Column) -> Column:
    """Drop zero-width characters, expand ligatures, NFKC, ASCII quotes and dashes.

    Pure ASCII text, most of it, skips all of this.
    """
    cleaned = F.translate(text, fixed.ZERO_WIDTH, "")
    for ligature, letters in fixed.LIGATURES.items():
        cleaned = F.replace(cleaned, F.lit(ligature), F.lit(letters))
    cleaned = F.translate(
        nfkc(cleaned), "".join(fixed.TYPOGRAPHIC), "".join(fixed.TYPOGRAPHIC.values())
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), cleaned).otherwise(text)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def first_number(text: Column) -> Column:
    """First run of digits as text, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First column that holds more than white space."""
    return F.coalesce(*[nullify(column) for column in columns])


def estimate_tokens(text: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(4))).cast("long")


def extract_json(text: Column) -> Column:
    """JSON text inside prose: fenced block, else outermost braces or brackets, else all."""
    body = strip(text)
    fenced = F.regexp_extract(body, r"(?i)```(?:json)?\s*([\s\S]*?)\s*```", 1)
    has_fence = body.rlike(r"```[\s\S]*?```")
    bare = F.regexp_extract(body, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1)
    return F.when(has_fence, strip(fenced)).when(bare != "", strip(bare)).otherwise(body)


def sql_literal(column: Column, kind: str) -> Column:
    """SQL literal for a value of the given Spark type name; NULL becomes NULL."""
    if kind == "boolean":
        shown = F.when(column, "TRUE").otherwise("FALSE")
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith(
        "decimal"
    ):
        shown = column.cast("string")
    else:
        shown = F.concat(
            F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")
        )
    return F.when(column.isNull(), F.lit("NULL")).otherwise(shown)


def page_list(pages: Column) -> Column:
    """Sorted distinct page numbers joined by a comma."""
    ordered = F.array_sort(F.array_distinct(pages))
    return F.array_join(F.transform(ordered, lambda page: page.cast("string")), ", ")


def export_name(name: Column, identifier: Column, extension: str) -> Column:
    """File name of an export: safe name, first 8 characters of the id, extension."""
    safe = strip_chars(F.regexp_replace(name, r"(?U)[^\w\-.]", "_"), "_")
    return F.concat(safe, F.lit("_"), F.substring(identifier, 1, 8), F.lit(f".{extension}"))


def audit_line(moment: Column, message: Column) -> Column:
    """`[2025-01-31 12:00:00] message`."""
    return F.concat(F.lit("["), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), message)


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)
