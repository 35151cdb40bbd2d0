"""Column-name functions, for header tables (Column) and for plan building (str)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps from a header to a name, in order, as (pattern, replacement).
SNAKE_STEPS = (
    (r"[^\w\s-]", ""),
    (r"^\s+|\s+$", ""),
    (r"[-\s]+", "_"),
    (r"(.)([A-Z][a-z]+)", r"\1_\2"),
    (r"([a-z0-9])([A-Z])", r"\1_\2"),
    (r"_+", "_"),
)


def snake_case(name: Column) -> Column:
    """`SAQA ID (new)` becomes `saqa_id_new`; an empty name `unnamed_column`."""
    text = name
    for pattern, put in SNAKE_STEPS:
        text = F.regexp_replace(text, f"(?U){pattern}", put.replace("\\", "$"))
    text = F.btrim(F.lower(text), F.lit("_"))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "unnamed_column")
        .when(text == "", "column")
        .otherwise(text)
    )


def snake_name(name: str | None) -> str:
    """The same rule for one name on the driver."""
    if not name:
        return "unnamed_column"
    for pattern, put in SNAKE_STEPS:
        name = re.sub(pattern, put, name)
    return name.lower().strip("_") or "column"


def fill_header(header: Column, position: Column, prefix: str = "Column_") -> Column:
    """Blank headers become `Column_1`, `Column_2`, … by position from 0."""
    text = F.btrim(header)
    return F.coalesce(
        F.when(text != "", text), F.concat(F.lit(prefix), (position + 1).cast("string"))
    )


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def unique_names(headers: DataFrame, table: Sequence[str], position: str, name: str) -> DataFrame:
    """Second and later uses of a name in one table get `_2`, `_3`, …"""
    window = Window.partitionBy(*table, name).orderBy(position)
    use = F.row_number().over(window)
    return headers.withColumn("_use", use).withColumn(
        name,
        F.when(F.col("_use") > 1, F.concat_ws("_", name, F.col("_use").cast("string"))).otherwise(
            F.col(name)
        ),
    ).drop("_use")


def unique_list(names: Sequence[str]) -> list[str]:
    """The same rule for a list of names on the driver."""
    uses: dict[str, int] = {}
    out = []
    for name in names:
        uses[name] = uses.get(name, 0) + 1
        out.append(name if uses[name] == 1 else f"{name}_{uses[name]}")
    return out


def dataset_name(
    filename: Column, extractor: Column, profile_dataset: Column | None = None
) -> Column:
    """Name of the dataset a document yields: profile, else extractor, else file name."""
    by_extractor = (
        F.when(extractor == "qualifications", "qualifications")
        .when(extractor == "codebook", "qlfs_codebook")
        .when(extractor == "occupations", "occupations_high_demand")
        .otherwise(
            F.concat(F.replace(F.lower(filename), F.lit(".pdf"), F.lit("")), F.lit("_table"))
        )
    )
    return by_extractor if profile_dataset is None else F.coalesce(profile_dataset, by_extractor)
