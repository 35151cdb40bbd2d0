"""Dataset quality scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions.text import is_blank


def cell_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records, cells, filled cells and modified cells, in one aggregation."""
    filled = sum(((~is_blank(F.col(f))).cast("long") for f in fields), F.lit(0))
    changed = [f for f in fields if f"{f}__mod" in df.columns]
    modified = sum((F.col(f"{f}__mod").cast("long") for f in changed), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum(filled), F.lit(0)).alias("filled_cells"),
        F.coalesce(F.sum(modified), F.lit(0)).alias("modified_cells"),
    ).withColumns(
        {
            "total_columns": F.lit(len(fields)).cast("long"),
            "total_cells": F.col("total_records") * F.lit(len(fields)),
        }
    )


def dataset_quality(
    df: DataFrame, fields: Sequence[str], summary: DataFrame, extraction: float = 0.95
) -> DataFrame:
    """Completeness, consistency, validation, extraction and their mean; 0 when empty.

    `summary` is the one-row validation summary of the same dataset.
    """
    # Two rows, one of counts and one of issues, become one.
    counts = cell_counts(df, fields)
    both = counts.unionByName(
        summary.select("critical_count", "warning_count"), allowMissingColumns=True
    )
    return scores(both.agg(*[F.max(c).alias(c) for c in both.columns]), extraction)


def scores(counts: DataFrame, extraction: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Quality of each row of counts: records, columns, cells, filled and modified cells, critical and warning issues."""
    records, cells = F.col("total_records"), F.col("total_cells")
    some = cells > 0

    def score(value: Column) -> Column:
        return F.bround(F.when(some, value).otherwise(F.lit(0.0)), 1)

    scored = counts.select(
        "*",
        F.lit(round(extraction * 100, 1)).alias("extraction_score"),
        score(F.col("filled_cells") / cells * 100).alias("completeness_score"),
        score(
            F.greatest(F.lit(70.0), F.lit(100.0) - F.col("modified_cells") / cells * 30.0)
        ).alias("consistency_score"),
        score(
            F.greatest(
                F.lit(0.0),
                F.lit(100.0)
                - F.col("critical_count") / records * 60.0
                - F.col("warning_count") / records * 20.0,
            )
        ).alias("validation_score"),
    )
    parts = ("extraction_score", "completeness_score", "consistency_score", "validation_score")
    return scored.select(
        *keys,
        score(sum((F.col(p) * 0.25 for p in parts), F.lit(0.0))).alias("overall_score"),
        *parts,
        "total_records",
        "total_columns",
        "total_cells",
        F.col("filled_cells").alias("non_null_cells"),
        F.bround(F.when(some, (cells - F.col("filled_cells")) / cells), 3).alias("empty_cell_ratio"),
        F.col("critical_count").alias("critical_issues"),
        F.col("warning_count").alias("warning_issues"),
    )


def penalty_score(total: Column, errors: Column, warnings: Column) -> Column:
    """100 less 1.5 points per error and 0.5 per warning, per hundred records."""
    penalty = (errors * 1.5 + warnings * 0.5) / total * 100
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - penalty))
    return F.when(total == 0, F.lit(100.0)).otherwise(F.bround(score, 1))


def quality_band(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "medium").otherwise("low")
