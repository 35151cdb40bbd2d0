"""Where records come from: provenance, data dictionary, manifests, stage metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from doctables.functions.text import is_blank, page_list
from doctables.operators.schema import Field, fields_frame


def attach_provenance(
    df: DataFrame,
    document: Column,
    page: Column,
    row: Column,
    method: Column,
    confidence: Column | None = None,
    section: Column | None = None,
    table: Column | None = None,
    document_id: Column | None = None,
    extracted_at: Column | None = None,
) -> DataFrame:
    """Add `_prov`, the source of the record, to every row."""
    none = F.lit(None).cast("string")
    trail = F.concat(
        F.lit("Extracted via "), method, F.lit(" from page "), page.cast("string")
    )
    return df.withColumn(
        "_prov",
        F.struct(
            document.alias("source_document"),
            (none if document_id is None else document_id.cast("string")).alias("source_document_id"),
            page.cast("int").alias("source_page"),
            (none if section is None else section).alias("source_section"),
            (none if table is None else table).alias("source_table"),
            row.cast("long").alias("source_row_idx"),
            method.alias("extraction_method"),
            (F.current_timestamp() if extracted_at is None else extracted_at).alias("extracted_at"),
            (F.lit(1.0) if confidence is None else confidence.cast("double")).alias("confidence"),
            F.lit("source_extracted").alias("status"),
            none.alias("reviewer_notes"),
            F.array(trail).alias("audit_trail"),
        ),
    )


def set_prov(df: DataFrame, **values: Column) -> DataFrame:
    """Replace fields of `_prov`."""
    prov = F.col("_prov")
    for name, value in values.items():
        prov = prov.withField(name, value)
    return df.withColumn("_prov", prov)


def provenance_rows(df: DataFrame, order: str, model: str = "deterministic") -> DataFrame:
    """Row provenance list: row, document, page, method, model, confidence."""
    return df.select(
        F.col(order).alias("row_index"),
        F.col("_prov.source_document").alias("document_filename"),
        F.coalesce("_prov.source_page", F.lit(1)).alias("page_number"),
        F.col("_prov.extraction_method").alias("method"),
        F.lit(model).alias("model"),
        F.coalesce("_prov.confidence", F.lit(1.0)).alias("confidence"),
    )


def provenance_summary(df: DataFrame, by: Sequence[str] = ("job_id", "dataset_name")) -> DataFrame:
    """Record count and page range per job and dataset."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.concat(F.lit("1-"), F.max("_prov.source_page").cast("string")).alias("source_page"),
    )


def modified_fields(df: DataFrame, fields: Sequence[str]) -> Column:
    """Names of the fields that normalisation changed, as an array column."""
    marks = [F.when(F.col(f"{f}__mod"), F.lit(f)) for f in fields]
    return F.filter(F.array(*marks), lambda name: name.isNotNull())


def data_dictionary(
    df: DataFrame, fields: Sequence[Field], order: str, page: str | None = None, dataset: str = "dataset",
) -> DataFrame:
    """One row per column: label, type, nullability, identifier mark, example, pages.

    The example is the first non-empty value by `order`; pages are all pages of the rows.
    A document's distinct page numbers are one value here, as in the output.
    """
    names = [f.name for f in fields if f.name in df.columns]
    packed = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("v")) for n in names]
    )
    examples = (
        df.select(order, F.inline(packed))
        .groupBy("name")
        .agg(F.min_by("v", F.when(~is_blank(F.col("v")), F.col(order))).alias("example_value"))
    )
    table = fields_frame(df.sparkSession, fields)
    shown = table.join(examples, "name", "left")
    if page is None:
        shown = shown.withColumn("source_pages", F.lit(""))
    else:
        first = df.select(F.col(page).cast("long").alias("p")).filter("p is not null").distinct()
        listed = first.agg(
            page_list(F.collect_list("p")).alias("source_pages")
        )
        shown = shown.withColumn("source_pages", listed.scalar())
    return shown.select(
        F.lit(dataset).alias("dataset_name"),
        F.col("name").alias("column_name"),
        F.col("source_header").alias("source_label"),
        F.lower("data_type").alias("data_type"),
        F.when(F.col("required"), "NO").otherwise("YES").alias("nullable"),
        F.concat(F.lit("Extracted column "), "name").alias("description"),
        F.when(F.col("is_primary_key") | F.col("name").isin("saqa_id", "ofo_code"), "YES")
        .otherwise("NO")
        .alias("identifier"),
        F.coalesce("example_value", F.lit("")).alias("example_value"),
        "source_pages",
    )


def bundle_counts(records: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """Records extracted, verified and to review.

    The review queue counts; without any entry there, records that are not valid do.
    """
    counts = records.agg(
        F.count(F.lit(1)).alias("records_extracted"),
        F.count_if(F.col("status").isin("valid", "human_reviewed")).alias("records_verified"),
        F.count_if(F.col("status").isin("warning", "error")).alias("_open"),
    )
    if review is None:
        return counts.withColumnRenamed("_open", "records_review_required")
    both = counts.unionByName(review.agg(F.count(F.lit(1)).alias("_queue")), allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.select(
        "records_extracted",
        "records_verified",
        F.when(F.col("_queue") > 0, F.col("_queue")).otherwise(F.col("_open")).alias(
            "records_review_required"
        ),
    )


def bundle_manifest(
    counts: DataFrame,
    document: str,
    document_hash: str,
    pages: int,
    datasets: Sequence[str],
    models: Sequence[str],
    profile: str,
    version: str,
) -> DataFrame:
    """One-row manifest of an extraction."""
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return counts.select(
        F.lit(document).alias("document"),
        F.lit(document_hash).alias("document_hash"),
        F.lit(pages).alias("pages"),
        texts(datasets).alias("datasets"),
        "records_extracted",
        "records_verified",
        "records_review_required",
        texts(models).alias("models"),
        F.lit(profile).alias("extraction_profile"),
        F.lit(version).alias("prompt_version"),
        F.current_timestamp().alias("processed_at"),
    )


def run_manifest(datasets: DataFrame, documents: DataFrame, summary: DataFrame) -> DataFrame:
    """Run totals: pages, records, valid records, methods, one entry per dataset.

    `datasets`: name, record_count, column_count, quality_score (one row per
    dataset). `documents`: page_count, method. Valid is all but records with issues.
    """
    totals = datasets.agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"),
        F.array_sort(
            F.collect_list(F.struct("name", "record_count", "column_count", "quality_score"))
        ).alias("datasets"),
    )
    read = documents.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"),
        F.array_sort(F.collect_set("method")).alias("extraction_methods"),
    )
    issues = summary.select("critical_count", "warning_count", "records_with_issues")
    parts = totals.unionByName(read, allowMissingColumns=True).unionByName(
        issues, allowMissingColumns=True
    )
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return one.select(
        "total_documents",
        "total_pages",
        "total_records",
        (F.col("total_records") - F.col("records_with_issues")).alias("records_valid"),
        F.col("warning_count").alias("records_with_warnings"),
        F.col("critical_count").alias("records_critical"),
        "extraction_methods",
        "datasets",
    )


class Stage:
    """Row count of a stage, measured while the stage runs anyway."""

    def __init__(self, name: str):
        self.name = name
        self._seen = Observation(name)

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self._seen, F.count(F.lit(1)).alias("records"))

    def metrics(self, spark, started: float, ended: float, failed: bool = False) -> DataFrame:
        """Call after an action on the watched frame has ended."""
        records = 0 if failed else self._seen.get["records"]
        status = "FAILED" if failed else "COMPLETE"
        return spark.createDataFrame(
            [(self.name, status, int((ended - started) * 1000), records)],
            "stage string, status string, duration_ms bigint, record_count bigint",
        )
