"""Readers: from raw input frames to rows of tables, by name.

A reader is a function from a frame to table rows; add your own, for example one
built on `mapInPandas`, with `register_reader`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions.fixed import (
    CODEBOOK_FIELDS,
    OCCUPATION_ALIASES,
    QUALIFICATION_ALIASES,
)
from doctables.model import TABLE
from doctables.operators import layout, stitch, tables

Reader = Callable[[DataFrame], DataFrame]

# Confidence of what each reader finds.
CONFIDENCE = {
    "pdf_tables": 0.88, "pdf_pymupdf": 0.92, "pdf_text": 0.75, "ocr": 0.70,
    "codebook": 0.94, "qualifications": 0.96, "occupations": 0.94,
}


def _marked(rows: DataFrame, method: str) -> DataFrame:
    return rows.withColumns(
        {"method": F.lit(method), "confidence": F.lit(CONFIDENCE[method])}
    )


def _as_cells(rows: DataFrame, fields) -> DataFrame:
    return rows.select(
        *TABLE,
        "row_idx",
        F.array(*[F.lit(f) for f in fields]).alias("headers"),
        F.array(*fields).alias("cells"),
    )


def _generic(rows: DataFrame) -> DataFrame:
    return _marked(tables.promote_headers(tables.clean_cells(rows)), "pdf_tables")


def _strict(rows: DataFrame) -> DataFrame:
    """Header is the first source row; tables of one row are skipped."""
    promoted = tables.promote_headers(
        rows.withColumn("cells", tables.strip_cells(F.col("cells"))), min_rows=2
    )
    return _marked(promoted.filter(tables.has_text(F.col("cells"))), "pdf_pymupdf")


def _qualifications(rows: DataFrame) -> DataFrame:
    fields = list(QUALIFICATION_ALIASES)
    return _marked(_as_cells(tables.qualification_rows(rows), fields), "qualifications")


def _occupations(rows: DataFrame) -> DataFrame:
    return _marked(_as_cells(tables.occupation_rows(rows), list(OCCUPATION_ALIASES)), "occupations")


def _codebook(rows: DataFrame) -> DataFrame:
    return _marked(_as_cells(tables.codebook_rows(rows), CODEBOOK_FIELDS), "codebook")


# Raw table rows go into all of these but pdf_text (word positions) and ocr (OCR words).
READERS: dict[str, Reader] = {
    "pdf_tables": _generic,
    "pdf_pymupdf": _strict,
    "pdf_text": layout.text_tables,
    "ocr": layout.ocr_tables,
    "codebook": _codebook,
    "qualifications": _qualifications,
    "occupations": _occupations,
}


def register_reader(name: str, reader: Reader) -> None:
    READERS[name] = reader


def get_reader(name: str) -> Reader:
    """Reader by name, the generic one for unknown names."""
    return READERS.get(name, READERS["pdf_tables"])


def read_best(
    readings: Mapping[str, DataFrame],
    primary: Column,
    enough: float = 0.65,
    fallback: bool = True,
    stitched: bool = True,
) -> DataFrame:
    """Rows of the best reading of every document, with its name and score.

    `readings`: reader name -> its rows. Parts of tables are joined before the
    readings are scored.
    """
    named = None
    for name, rows in readings.items():
        if stitched:
            rows = stitch.stitch_tables(rows).select(
                "doc_id",
                F.col("master_page").alias("page"),
                F.col("master_index").alias("table_index"),
                F.struct("page", "table_index", "row_idx").alias("at"),
                "headers",
                "cells",
            )
        else:
            rows = rows.select(
                *TABLE, F.struct("page", "table_index", "row_idx").alias("at"), "headers", "cells"
            )
        rows = rows.withColumn("strategy", F.lit(name))
        named = rows if named is None else named.unionByName(rows)
    scores = tables.extraction_quality(
        named.withColumnRenamed("at", "row_idx"), by=("doc_id", "strategy")
    )
    best = tables.best_strategy(scores, primary, enough=enough, fallback=fallback)
    return named.join(best, ["doc_id", "strategy"])
