"""Canonical spellings for the fixed domains of the relational model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.text import strip


def framework(text: Column) -> Column:
    """Framework code by the words it contains; other text in upper case."""
    upper = F.upper(strip(F.coalesce(F.nullif(text, F.lit("")), F.lit("OQSF"))))
    return (
        F.when(upper.contains("OQSF") | upper.contains("OCCUPATIONAL"), "OQSF")
        .when(upper.contains("HEQSF") | upper.contains("HIGHER"), "HEQSF")
        .when(upper.rlike("GFET|GENERAL|FURTHER"), "GFETQSF")
        .otherwise(upper)
    )


def yes_no(text: Column) -> Column:
    """YES or NO from synonyms; blank is NO; other text in upper case."""
    upper = F.upper(strip(F.coalesce(text, F.lit(""))))
    return (
        F.when(upper.isin(*fixed.ELIGIBLE_WORDS), "YES")
        .when(upper.isin(*fixed.NOT_ELIGIBLE_WORDS) | (upper == ""), "NO")
        .otherwise(upper)
    )


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.60, "medium").otherwise("low")


def confidence_text(text: Column) -> Column:
    """Allowed words pass, all else is medium."""
    lower = F.lower(strip(text))
    return F.when(lower.isin(*fixed.ALLOWED_CONFIDENCE), lower).otherwise("medium")


def confidence_score(band: Column) -> Column:
    return F.when(band == "high", 1.0).when(band == "medium", 0.8).otherwise(0.5)


def merge_maps(base: Column, patch: Column) -> Column:
    """Two maps in one; the patch wins."""
    absent = F.map_filter(base, lambda key, _: ~F.map_contains_key(patch, key))
    return F.map_concat(absent, patch)
