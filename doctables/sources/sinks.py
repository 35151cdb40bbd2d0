"""Sinks: CSV, JSON, parquet, SQL scripts, bundles, manifests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import canon
from doctables.functions.cells import norm_view
from doctables.functions.text import sql_literal
from doctables.model import SQL_TYPES, field_type
from doctables.operators.relational import joined_children
from doctables.operators.schema import Field
from doctables.operators.serve import project_columns


def flatten_provenance(df: DataFrame) -> DataFrame:
    """Replace `_prov` by the flat columns of an export."""
    return df.withColumns(
        {
            "_prov_doc": F.coalesce("_prov.source_document", F.lit("")),
            "_prov_page": F.col("_prov.source_page"),
            "_prov_confidence": F.coalesce("_prov.confidence", F.lit(1.0)),
            "_prov_status": F.coalesce("status", F.lit("valid"))
            if "status" in df.columns
            else F.col("_prov.status"),
        }
    ).drop("_prov")


def export_frame(
    df: DataFrame, include_provenance: bool = True, selected: Sequence[str] | None = None
) -> DataFrame:
    """What an export writes: normal values, chosen columns, flat provenance."""
    out = norm_view(df)
    if "_prov" in out.columns:
        out = flatten_provenance(out) if include_provenance else out.drop("_prov")
    return project_columns(out, selected) if selected else out


def _csv(df: DataFrame, path: str, **options) -> None:
    texts = {
        c: F.array_join(F.col(c), "; ") if t == "array<string>" else F.to_json(F.col(c))
        for c, t in df.dtypes
        if t.startswith(("array", "map", "struct"))
    }
    df.withColumns(texts).write.mode("overwrite").options(**options).csv(
        path, header=True, encoding="UTF-8", escape='"'
    )


def _json(df: DataFrame, path: str, **options) -> None:
    df.write.mode("overwrite").options(**options).json(path)


def _parquet(df: DataFrame, path: str, **options) -> None:
    df.write.mode("overwrite").options(**options).parquet(path)


# format -> (frame, path, options). Add your own with `register_exporter`.
EXPORTERS: dict[str, Callable[..., None]] = {"csv": _csv, "json": _json, "parquet": _parquet}


def register_exporter(name: str, write: Callable[..., None]) -> None:
    EXPORTERS[name] = write


def export(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    include_provenance: bool = True,
    selected: Sequence[str] | None = None,
    **options,
) -> None:
    """Write one dataset. An unknown format is an error."""
    name = fmt.lower().strip()
    if name not in EXPORTERS:
        raise ValueError(f"unsupported export format: {fmt}")
    EXPORTERS[name](export_frame(df, include_provenance, selected), path, **options)


def export_all(datasets: Mapping[str, DataFrame], folder: str, fmt: str = "csv", **options) -> list[str]:
    """Write every dataset into its own folder."""
    paths = []
    for name, df in datasets.items():
        paths.append(f"{folder}/{name}.{fmt}")
        export(df, paths[-1], fmt, **options)
    return paths


def json_envelope(df: DataFrame, name: str, fields: Sequence[Field], metadata: Mapping[str, str]) -> DataFrame:
    """Head of a JSON export as one row; the records are written next to it."""
    columns = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.display_name or f.name).alias("display_name"),
                F.lit(f.data_type).alias("data_type"),
                F.lit(f.required).alias("required"),
                F.lit(f.is_primary_key).alias("is_primary_key"),
            )
            for f in fields
        ]
    )
    meta = F.create_map(
        F.lit("name"), F.lit(name), *[F.lit(x) for pair in metadata.items() for x in pair]
    )
    return df.agg(F.count(F.lit(1)).alias("record_count")).select(
        meta.alias("metadata"), columns.alias("columns"), "record_count"
    )


def export_json_with_envelope(
    df: DataFrame, folder: str, name: str, fields: Sequence[Field], metadata: Mapping[str, str] | None = None
) -> None:
    json_envelope(df, name, fields, metadata or {}).write.mode("overwrite").json(f"{folder}/{name}/envelope")
    export(df, f"{folder}/{name}/records", "json")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def create_table_sql(
    name: str, fields: Sequence[Field], primary_key: Sequence[str] = (), description: str = ""
) -> str:
    """CREATE TABLE for a dataset; PRIMARY KEY as a named constraint."""
    lines = [
        f"    {quoted(f.name)} {SQL_TYPES.get(f.data_type, 'TEXT')} {'NOT NULL' if f.required else 'NULL'}"
        for f in fields
    ]
    if primary_key:
        keys = ", ".join(quoted(k) for k in primary_key)
        lines.append(f"    CONSTRAINT {quoted(f'pk_{name}')} PRIMARY KEY ({keys})")
    head = f"-- Table: {name}\n" + (f"-- {description}\n" if description else "")
    return head + f"CREATE TABLE IF NOT EXISTS {quoted(name)} (\n" + ",\n".join(lines) + "\n);"


def foreign_key_sql(parent: str, child: str, parent_key: str, foreign_key: str) -> str:
    return (
        f"ALTER TABLE {quoted(child)} ADD CONSTRAINT {quoted(f'fk_{child}_{parent}')} "
        f"FOREIGN KEY ({quoted(foreign_key)}) REFERENCES {quoted(parent)}({quoted(parent_key)}) "
        f"ON DELETE CASCADE;"
    )


def fields_of(df: DataFrame, required: Sequence[str] = ()) -> list[Field]:
    """Fields that describe the columns of a typed frame."""
    return [Field(c, field_type(t), required=c in required) for c, t in df.dtypes]


def insert_lines(df: DataFrame, name: str) -> DataFrame:
    """One INSERT statement per row, column `line`."""
    columns = ", ".join(quoted(c) for c in df.columns)
    values: list[Column] = []
    for i, (c, t) in enumerate(df.dtypes):
        if i:
            values.append(F.lit(", "))
        if t == "array<string>":
            items = F.array_join(F.transform(F.col(c), lambda x: sql_literal(x, "string")), ", ")
            values.append(
                F.when(F.col(c).isNull(), "NULL").otherwise(
                    F.concat(F.lit("ARRAY["), items, F.lit("]::TEXT[]"))
                )
            )
        else:
            values.append(sql_literal(F.col(c), t))
    return df.select(
        F.concat(
            F.lit(f"INSERT INTO {quoted(name)} ({columns}) VALUES ("), *values, F.lit(");")
        ).alias("line")
    )


def write_sql(
    datasets: Mapping[str, tuple[DataFrame, Sequence[Field], Sequence[str]]],
    folder: str,
    relationships: Sequence[Mapping[str, object]] = (),
) -> None:
    """SQL script of all datasets: `ddl` first, then the INSERT files of each table.

    `datasets`: name -> (frame, fields, primary key), parents before children. Only
    accepted relationships become foreign keys, which are added by `keys` at the end.
    """
    frames = list(datasets.items())
    spark = frames[0][1][0].sparkSession

    def text(lines: Sequence[str], path: str) -> None:
        spark.createDataFrame([("\n".join(lines),)], "line string").coalesce(1).write.mode(
            "overwrite"
        ).text(path)

    text(
        ["BEGIN;", *[create_table_sql(n, fields, key) for n, (_, fields, key) in frames], "COMMIT;"],
        f"{folder}/ddl",
    )
    for name, (df, _, _) in frames:
        insert_lines(norm_view(df), name).write.mode("overwrite").text(f"{folder}/data/{name}")
    keys = [
        foreign_key_sql(r["parent_dataset"], r["child_dataset"], r["parent_key"], r["foreign_key"])
        for r in relationships
        if r.get("is_accepted", True)
    ]
    text(["BEGIN;", *keys, "COMMIT;"], f"{folder}/keys")


def relational_export(
    qualifications: DataFrame,
    colleges: tuple[DataFrame, str],
    centres: tuple[DataFrame, str],
    max_items: int = 100_000,
) -> DataFrame:
    """Qualifications with joined college names and programmes, ready for export.

    The child tables come with the integer column that orders them.
    """
    joined = joined_children(
        qualifications,
        {
            "participating_colleges": (colleges[0], colleges[1], "college_name"),
            "dspp_programmes": (centres[0], centres[1], "programme_context"),
        },
        "saqa_id",
        max_items=max_items,
    )
    return joined.withColumns(
        {
            "nqf_level": F.coalesce("nqf_level", F.lit("")),
            "_prov_confidence": canon.confidence_score(F.col("confidence")),
            "_prov_status": F.lit("valid"),
        }
    )


def valid_records(records: DataFrame, only_valid: bool = True, order: str = "row_index") -> DataFrame:
    """Records for an export in row order, optionally only valid and reviewed ones."""
    kept = records.filter(F.col("status").isin("valid", "human_reviewed")) if only_valid else records
    return kept.orderBy(order)


def write_one(df: DataFrame, path: str) -> None:
    """A one-row report (manifest, summary) as a single JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_issues(issues: DataFrame, summary: DataFrame, folder: str) -> None:
    """Validation report: issues and their summary."""
    issues.write.mode("overwrite").json(f"{folder}/issues")
    write_one(summary, f"{folder}/summary")


def write_bundle(dictionary: DataFrame, provenance: DataFrame, manifest: DataFrame, folder: str) -> None:
    """Research bundle: data dictionary, row provenance, manifest."""
    _csv(dictionary.coalesce(1), f"{folder}/data_dictionary")
    _csv(provenance, f"{folder}/provenance")
    write_one(manifest, f"{folder}/extraction_manifest")


def save_raw_rows(rows: DataFrame, path: str) -> None:
    """Raw rows, one per line, however large their tables are."""
    rows.write.mode("overwrite").json(path)


def save_datasets(datasets: DataFrame, path: str, dataset: str = "dataset") -> None:
    """Records of many datasets; a run replaces the datasets it holds and no other."""
    datasets.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        dataset
    ).parquet(path)
