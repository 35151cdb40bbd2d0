"""Streams that run the batch operators as data arrives.

Checkpoints and outputs belong in storage that all executors can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doctables.operators.rules import validate_records
from doctables.operators.schema import Field


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def append(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Append a stream to a parquet folder; the file sink writes every row once."""
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def intake(
    stream: DataFrame,
    steps: Sequence[Callable[[DataFrame], DataFrame]],
    path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Row-wise batch operators on a stream: inspect, classify, normalise."""
    for step in steps:
        stream = stream.transform(step)
    return append(stream, path, checkpoint, available_now)


def validation_split(
    stream: DataFrame,
    fields: Sequence[Field],
    record_id: str,
    records_path: str,
    issues_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Records with their status and a table of issues, from one stream.

    Each micro-batch overwrites its own `batch` partition, so that a batch that runs
    again after a failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = validate_records(batch, fields).withColumn("batch", F.lit(number))
        checked.persist()
        try:
            for frame, path in (
                (checked.drop("issues"), records_path),
                (checked.select(record_id, F.inline("issues"), "batch"), issues_path),
            ):
                frame.write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic"
                ).partitionBy("batch").parquet(path)
        finally:
            checked.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def first_seen(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """One row per key, as long as repeats arrive within the watermark delay."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def activity_rate(
    rows: DataFrame,
    time: str,
    by: Sequence[str],
    length: str = "1 hour",
    slide: str | None = None,
    late: str | None = "1 hour",
    session: bool = False,
) -> DataFrame:
    """Rows per time window and group; sliding or session windows on request.

    The same call counts a stream (give `late`) and a batch.
    """
    # A watermark needs an instant; a batch keeps times without a zone as they are.
    stamped = rows
    if late is not None:
        stamped = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window: Column = (
        F.session_window(time, length) if session else F.window(time, length, slide or length)
    )
    return (
        stamped.groupBy(window.alias("_window"), *by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            *by,
            "rows",
        )
    )


def latest_totals(
    totals: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write what each batch changes in a streaming aggregation to a folder of its own.

    Windows older than the watermark leave the state, and their last version stays
    in the files. A repeated batch writes its own folder again and nothing else.
    `current_totals` reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def current_totals(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last version of every key that `latest_totals` wrote."""
    versions = spark.read.parquet(path)
    values = [c for c in versions.columns if c not in (*keys, "batch")]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")
