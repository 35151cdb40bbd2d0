"""Column names and schemas shared by the operators.

Raw rows: doc_id, page, table_index, row_idx (position in its table from 0),
cells array<string>, and per table: headers array<string>, method, confidence.
Row grain everywhere; a table or document never sits in one cell.
"""

from __future__ import annotations

from pyspark.sql import types as T

TABLE = ["doc_id", "page", "table_index"]

RAW_ROWS = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("table_index", T.IntegerType(), False),
        T.StructField("row_idx", T.LongType(), False),
        T.StructField("headers", T.ArrayType(T.StringType())),
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Raw extraction dump: one JSON document per source document.
RAW_DUMP = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField(
            "tables",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("page_number", T.IntegerType()),
                        T.StructField("table_index", T.IntegerType()),
                        T.StructField("headers", T.ArrayType(T.StringType())),
                        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
                        T.StructField("extraction_method", T.StringType()),
                        T.StructField("confidence", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)

# Type names of the fields and their SQL and Spark forms.
SQL_TYPES = {
    "STRING": "TEXT", "INTEGER": "INTEGER", "FLOAT": "NUMERIC(12, 4)", "BOOLEAN": "BOOLEAN",
    "DATE": "DATE", "LIST": "TEXT[]", "JSON": "JSONB",
}
SPARK_TYPES = {
    "STRING": "string", "INTEGER": "bigint", "FLOAT": "double", "BOOLEAN": "boolean",
    "DATE": "date", "LIST": "array<string>", "JSON": "variant",
}


def field_type(spark_type: str) -> str:
    """Field type name for a Spark type name."""
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return "INTEGER"
    if spark_type in ("float", "double") or spark_type.startswith("decimal"):
        return "FLOAT"
    if spark_type.startswith("array"):
        return "LIST"
    if spark_type.startswith(("struct", "map", "variant")):
        return "JSON"
    return {"boolean": "BOOLEAN", "date": "DATE"}.get(spark_type, "STRING")
