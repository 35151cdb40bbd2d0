"""The whole way from raw rows to validated datasets, as one plan per result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.functions.cells import normalize_frame
from doctables.operators import quality, relational, rules, schema
from doctables.operators.documents import classify, found_words, keywords
from doctables.operators.pages import document_rollup, page_stats
from doctables.operators.provenance import attach_provenance
from doctables.operators.stitch import stitch_tables
from doctables.operators.tables import clean_cells, promote_headers, records_by_position
from doctables.sources.profiles import Profile
from doctables.sources.sinks import export_all


@dataclass
class Result:
    """Frames of a run. Nothing is computed until they are used or written."""

    fields: list[schema.Field]
    datasets: dict[str, DataFrame]
    primary_key: list[str]
    issues: DataFrame
    summary: DataFrame
    quality: DataFrame
    relationships: list[dict] = field(default_factory=list)

    def export(self, folder: str, fmt: str = "csv", **options) -> list[str]:
        return export_all(self.datasets, folder, fmt, **options)


def inspect(pages: DataFrame, names: DataFrame, profiles: Sequence[Profile], max_pages: int | None = None) -> DataFrame:
    """Documents with statistics and classification. `names`: doc_id, filename; `max_pages` limits the statistics."""
    stats = page_stats(pages)
    docs = names.join(document_rollup(stats, max_pages), "doc_id", "left").join(
        found_words(pages, keywords(profiles)), "doc_id", "left"
    )
    return classify(docs, profiles)


def rebuild(raw_rows: DataFrame) -> DataFrame:
    """Clean rows of whole tables from the raw rows of page tables.

    `row_index`, a struct, orders the rows of all documents and is unique.
    """
    rows = clean_cells(raw_rows)
    if "headers" not in rows.columns:
        rows = promote_headers(rows)
    return stitch_tables(rows).withColumn(
        "row_index", F.struct("doc_id", "page", "table_index", "row_idx")
    )


def layouts(rows: DataFrame) -> DataFrame:
    """Header rows that occur, with their number of rows: one dataset each."""
    return rows.groupBy("headers").agg(F.count(F.lit(1)).alias("rows"))


def _only_layout(rows: DataFrame) -> list[str]:
    found = layouts(rows).limit(2).collect()
    if len(found) != 1:
        raise ValueError("name the headers: the rows hold no or several layouts")
    return list(found[0]["headers"] or [])


def run(
    rows: DataFrame,
    dataset: str,
    profile: Profile | None = None,
    order: str = "row_index",
    headers: Sequence[str] | None = None,
    overrides: Sequence[schema.Field] = (),
    user_rules: Sequence[rules.Rule] = (),
    work_dir: str | None = None,
) -> Result:
    """Normalise, infer the schema, deduplicate, decompose, validate and score.

    `rows`: cells (array) or named columns, a unique `order` column (number or struct),
    and optionally doc_id, page, method, confidence. Rows with cells need `headers`
    unless all of them share one layout; filter them by it first. With `work_dir` the normalised records are
    written once and read by all later steps; give it for large inputs.
    """
    known = (
        "doc_id", "page", "table_index", "row_idx", "method", "confidence", "headers",
        "master_page", "master_index",
    )
    source = [c for c in known if c in rows.columns]
    if headers is None:
        if "cells" in rows.columns:
            headers = _only_layout(rows)
        else:
            headers = [c for c in rows.columns if c not in (*source, order)]
    named = rows
    if "cells" in rows.columns:
        named = records_by_position(rows, [f"_c{i}" for i in range(len(headers))])
        columns = [f"_c{i}" for i in range(len(headers))]
    else:
        columns = list(headers)

    # Normal form under provisional names: the types are voted on normal values.
    if profile is not None:
        matched = [schema.profile_field(h, profile.fields) for h in headers]
    else:
        matched = [None] * len(headers)
    names = schema.unique_list(
        [m.name if m else schema.snake_name(h) for h, m in zip(headers, matched)]
    )
    if overrides:
        names = [f.name for f in overrides][: len(columns)]
        columns = columns[: len(names)]
        headers = list(headers)[: len(names)]
    renamed = named.withColumnsRenamed(dict(zip(columns, names)))
    records = normalize_frame(renamed, names)
    records = attach_provenance(
        records,
        F.col("doc_id").cast("string") if "doc_id" in records.columns else F.lit(dataset),
        F.col("page") if "page" in records.columns else F.lit(1),
        F.col("row_idx") if "row_idx" in records.columns else F.col(order),
        F.col("method") if "method" in records.columns else F.lit("table"),
        F.col("confidence") if "confidence" in records.columns else None,
    ).drop(*source)
    if work_dir:
        records.write.mode("overwrite").parquet(f"{work_dir}/{dataset}/normalized")
        records = rows.sparkSession.read.parquet(f"{work_dir}/{dataset}/normalized")

    fields = schema.detect_fields(
        records.select(*names),
        headers,
        profile.fields if profile else (),
        profile.primary_key if profile else (),
        overrides,
    )
    key = [f.name for f in fields if f.is_primary_key]
    unique = relational.deduplicate(records, order, key or names)

    datasets, relationships = {dataset: unique}, []
    parent, parent_fields = unique, fields
    many = schema.detect_list_column(unique, names) if key else None
    if many:
        profile_child = profile.datasets[1][0] if profile and len(profile.datasets) > 1 else None
        child, item = relational.child_names(dataset, many, profile_child)
        parent = relational.decompose_parent(unique, many, key[0], order)
        parent_fields = [f for f in fields if f.name != many]
        datasets = {
            dataset: parent,
            child: relational.decompose_child(
                unique, many, key[0], item, order=order,
                carried=[c for c in ("doc_id", "page", "_prov") if c in unique.columns],
            ),
        }
        relationships.append(
            {
                "name": f"{dataset}_to_{child}", "parent_dataset": dataset, "child_dataset": child,
                "parent_key": key[0], "foreign_key": key[0], "is_accepted": True,
            }
        )

    checks = list(user_rules) or rules.default_rules(parent_fields)
    issues = rules.validate(parent, checks, record_id=order)
    summary = rules.summarize(issues)
    score = quality.dataset_quality(parent, [f.name for f in parent_fields], summary)
    return Result(fields, datasets, key, issues, summary, score, relationships)
