"""Cell normalisation: raw text in; normal form, kind and change flag out.

Each stage is its own projection, so that an expression used by several later
ones is computed once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.text import clean_unicode, collapse, strip


def is_code_field(name: str) -> bool:
    return any(term in name.lower() for term in fixed.CODE_TERMS)


def is_province_field(name: str) -> bool:
    return any(term in name.lower() for term in fixed.PROVINCE_TERMS)


def plain_number(text: Column) -> Column:
    """Canonical digits: no leading zeros, no trailing decimal zeros, no minus zero."""
    short = F.regexp_replace(text, r"^(-?)0+([0-9])", "$1$2")
    short = F.regexp_replace(short, r"(\.[0-9]+?)0+$", "$1")
    return F.when(short == "-0", "0").otherwise(short)


def kind_of(clean: Column, code: bool, province: bool) -> Column:
    """null, int, float, bool, province or str for cleaned text."""
    lower = F.lower(clean)
    rule = F.when(lower.isin(*fixed.NULL_TOKENS), "null")
    if not code:
        rule = rule.when(clean.rlike(r"^-?[0-9]+$"), "int")
        rule = rule.when(clean.rlike(r"^-?[0-9]+\.[0-9]+$"), "float")
    rule = rule.when(lower.isin(*fixed.TRUE_WORDS, *fixed.FALSE_WORDS), "bool")
    if province:
        rule = rule.when(lower.isin(*fixed.PROVINCES), "province")
    return F.when(clean.isNull(), "null").otherwise(rule.otherwise("str"))


def normal_form(clean: Column, kind: Column) -> Column:
    lower = F.lower(clean)
    names = F.create_map(*[F.lit(text) for pair in fixed.PROVINCES.items() for text in pair])
    return (
        F.when(kind == "null", None)
        .when(kind.isin("int", "float"), plain_number(clean))
        .when(kind == "bool", lower.isin(*fixed.TRUE_WORDS).cast("string"))
        .when(kind == "province", F.element_at(names, lower))
        .otherwise(clean)
    )


def changed(raw: Column, clean: Column, kind: Column, norm: Column) -> Column:
    """Whether normalisation changed the cell; numbers compare as cleaned text."""
    shown = F.initcap(norm)
    return F.coalesce(
        F.when(kind == "null", strip(raw) != "")
        .when(kind.isin("int", "float"), clean != raw)
        .when(kind == "bool", shown != raw)
        .otherwise(norm != raw),
        F.lit(False),
    )


def normalize_frame(
    df: DataFrame, fields: Sequence[str], code_fields: Iterable[str] | None = None
) -> DataFrame:
    """Normalise text columns in one pass and keep the raw values.

    For every field `f`: `f` holds the normal form (text), `f__raw` the source,
    `f__kind` null/int/float/bool/str and `f__mod` the change flag.
    `code_fields` replaces the rule that finds code columns by their name.
    """
    chosen = None if code_fields is None else set(code_fields)
    codes = {f: is_code_field(f) if chosen is None else f in chosen for f in fields}
    places = {f: is_province_field(f) for f in fields}

    staged = df.withColumnsRenamed({f: f"{f}__raw" for f in fields})
    staged = staged.withColumns(
        {f"{f}__clean": collapse(clean_unicode(F.col(f"{f}__raw").cast("string"))) for f in fields}
    )
    staged = staged.withColumns(
        {f"{f}__kind": kind_of(F.col(f"{f}__clean"), codes[f], places[f]) for f in fields}
    )
    staged = staged.withColumns(
        {f: normal_form(F.col(f"{f}__clean"), F.col(f"{f}__kind")) for f in fields}
    )
    staged = staged.withColumns(
        {
            f"{f}__mod": changed(
                F.col(f"{f}__raw").cast("string"),
                F.col(f"{f}__clean"),
                F.col(f"{f}__kind"),
                F.col(f),
            )
            for f in fields
        }
    )
    kept = [c for c in df.columns if c not in fields]
    out = [F.col(c) for c in kept]
    for f in fields:
        kind = F.when(F.col(f"{f}__kind") == "province", "str").otherwise(F.col(f"{f}__kind"))
        out += [F.col(f), F.col(f"{f}__raw"), kind.alias(f"{f}__kind"), F.col(f"{f}__mod")]
    return staged.select(*out)


def normalize_text(text: Column, field: str = "") -> Column:
    """Normal form of one column, for use inside other expressions."""
    clean = collapse(clean_unicode(text))
    kind = kind_of(clean, is_code_field(field), is_province_field(field))
    return normal_form(clean, kind)


def to_cells(df: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Long form, one row per cell: ids, field, raw, norm, kind, is_modified."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"{f}__raw").cast("string").alias("raw"),
                F.col(f).alias("norm"),
                F.col(f"{f}__kind").alias("kind"),
                F.col(f"{f}__mod").alias("is_modified"),
            )
            for f in fields
        ]
    )
    return df.select(*ids, F.inline(cells))


def raw_view(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The frame with source values, helper columns dropped."""
    kept = [c for c in df.columns if not c.endswith(("__raw", "__kind", "__mod"))]
    return df.select(*[F.col(f"{c}__raw").alias(c) if c in fields else F.col(c) for c in kept])


def norm_view(df: DataFrame) -> DataFrame:
    """The frame with normal values only."""
    return df.select(*[c for c in df.columns if not c.endswith(("__raw", "__kind", "__mod"))])
