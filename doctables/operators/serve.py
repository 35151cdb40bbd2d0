"""Filters, searches, pages of records, feeds and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.operators.quality import quality_band


def contains_text(df: DataFrame, needle: str, columns: Sequence[str] | None = None) -> Column:
    """Any column contains the needle, in any case."""
    hit = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.lower()), F.lit(False))
    return hit


def search(
    df: DataFrame,
    needle: str | None = None,
    columns: Sequence[str] | None = None,
    status: str | None = None,
    dataset: tuple[str, object] | None = None,
) -> DataFrame:
    """Records by dataset, status and text; every condition is optional."""
    out = df if dataset is None else df.filter(F.col(dataset[0]) == dataset[1])
    out = out if status is None else out.filter(F.col("status") == status)
    return out if not needle else out.filter(contains_text(out, needle, columns))


def record_page(df: DataFrame, order: Sequence[str], page: int = 1, size: int = 50) -> DataFrame:
    """One page of the filtered records; count the frame itself for the total."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(
    df: DataFrame, order: Sequence[str], after: Sequence[object] | None, size: int = 50
) -> DataFrame:
    """The page behind the row with these order values; depth does not matter.

    An offset reads and drops all pages before it, this filter is pushed down.
    """
    if after is not None:
        behind = F.lit(False)
        for i, column in enumerate(order):
            same = F.lit(True)
            for c, v in zip(order[:i], after[:i]):
                same = same & (F.col(c) == F.lit(v))
            behind = behind | (same & (F.col(column) > F.lit(after[i])))
        df = df.filter(behind)
    return df.orderBy(*order).limit(size)


def newest(df: DataFrame, by: str = "created_at", where: Mapping[str, object] | None = None) -> DataFrame:
    """Newest first, optionally of one project or owner."""
    return where_all(df, where or {}).orderBy(F.desc(by))


def latest(
    df: DataFrame,
    count: int,
    by: Sequence[str] = ("created_at",),
    where: Mapping[str, object] | None = None,
) -> DataFrame:
    """The latest `count` rows, at least one, newest first."""
    kept = max(1, count)
    return where_all(df, where or {}).orderBy(*[F.desc(c) for c in by]).limit(kept)


def where_all(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows that equal all given values; None means no condition."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def by_id(df: DataFrame, value: object, column: str = "id") -> DataFrame:
    return df.filter(F.col(column) == value)


def project_columns(df: DataFrame, selected: Sequence[str], protected: str = "_prov_") -> DataFrame:
    """The selected columns and those with the protected prefix, in frame order."""
    return df.select(*[c for c in df.columns if c in selected or c.startswith(protected)])


def pending_counts(df: DataFrame, column: str = "resolution", pending: str = "requires_review") -> DataFrame:
    """Rows in all, pending and resolved."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(column) == pending).alias("pending"),
        F.count_if(F.col(column) != pending).alias("resolved"),
    )


def kpis(datasets: DataFrame) -> DataFrame:
    """Totals over datasets and their mean quality; 100 when there is none.

    `datasets`: record_count, valid_count, warning_count, error_count, quality_score.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return datasets.agg(
        F.count(F.lit(1)).alias("datasets"),
        zero("record_count").alias("records"),
        zero("valid_count").alias("valid"),
        zero("warning_count").alias("warnings"),
        zero("error_count").alias("errors"),
        F.coalesce(F.bround(F.avg("quality_score"), 1), F.lit(100.0)).alias("mean_quality"),
    )


def band_counts(datasets: DataFrame, score: str = "quality_score") -> DataFrame:
    return datasets.groupBy(quality_band(F.col(score)).alias("band")).agg(
        F.count(F.lit(1)).alias("datasets")
    )
