"""Scans: file catalogue, raw extraction dumps, stored datasets, golden tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.model import RAW_DUMP


def file_catalogue(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """Files of a folder: name, path, size, change time, content.

    The bytes are only read by plans that use `content`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    )


def with_fingerprints(files: DataFrame) -> DataFrame:
    """Add SHA-256 and MD5 of the content, drop the content."""
    return files.withColumns({"sha256": F.sha2("content", 256), "md5": F.md5("content")}).drop("content")


def read_raw_dump(spark: SparkSession, path: str) -> DataFrame:
    """Nested extraction dumps (one JSON document per file) as raw rows."""
    dumps = spark.read.schema(RAW_DUMP).option("multiLine", True).json(path)
    tables = dumps.select(
        F.coalesce("document_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).alias(
            "doc_id"
        ),
        F.explode("tables").alias("t"),
    )
    return tables.select(
        "doc_id",
        F.col("t.page_number").alias("page"),
        F.coalesce("t.table_index", F.lit(0)).alias("table_index"),
        F.col("t.headers").alias("headers"),
        F.col("t.extraction_method").alias("method"),
        F.col("t.confidence").alias("confidence"),
        F.posexplode("t.rows").alias("row_idx", "cells"),
    ).withColumn("row_idx", F.col("row_idx").cast("long"))


def read_raw_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw rows saved one per line."""
    from doctables.model import RAW_ROWS

    return spark.read.schema(schema or RAW_ROWS).json(path)


def read_datasets(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable lines) of stored JSON datasets."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = spark.read.text(path).select(
        "value", F.from_json("value", marked, options).alias("row")
    ).filter(F.trim("value") != "")
    broken = F.col("row._corrupt_record").isNotNull()
    good = read.filter(~broken).select("row.*").drop("_corrupt_record")
    return good, read.filter(broken).select(F.col("value").alias("line"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden CSV; every column stays text, so leading zeros survive."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
