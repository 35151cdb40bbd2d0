"""Token counts, cost, and results of outside models kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_cost(
    usage: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("provider", "model")
) -> DataFrame:
    """Cost in USD from prices per million tokens; an unknown model costs nothing.

    `usage`: keys, prompt_tokens, completion_tokens. `prices`: keys, input_per_m,
    output_per_m, one row per key.
    """
    cost = (
        F.col("prompt_tokens") / F.lit(1_000_000.0) * F.coalesce("input_per_m", F.lit(0.0))
        + F.col("completion_tokens") / F.lit(1_000_000.0) * F.coalesce("output_per_m", F.lit(0.0))
    )
    return usage.join(prices, list(keys), "left").withColumn("cost", F.bround(cost, 6)).drop(
        "input_per_m", "output_per_m"
    )


def usage_rollup(usage: DataFrame, by: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Calls, tokens and cost per job."""
    return usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.sum("cost").alias("cost"),
    )


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Result of the primary source, of the fallback where the primary failed.

    Both: keys, result (NULL when the call failed), source.
    """
    second = fallback.filter(F.col("result").isNotNull()).select(
        *keys, F.col("result").alias("_result"), F.col("source").alias("_source")
    )
    failed = F.col("result").isNull() & F.col("_result").isNotNull()
    return (
        primary.join(second, keys, "left")
        .withColumns(
            {
                "source": F.when(failed, F.concat("_source", F.lit(" (fallback)"))).otherwise(
                    F.col("source")
                ),
                "result": F.coalesce("result", "_result"),
            }
        )
        .drop("_result", "_source")
    )
