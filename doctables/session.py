"""Session defaults the operators rely on.

On a cluster, submit with your own master and sizes; `tune` only sets what
the results depend on (UTC) and what the plans expect (adaptive execution).
"""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Needed unless the package is installed there or was given to --py-files.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='doctables-')}/doctables", "zip", root.parent, root.name
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def tune(builder: SparkSession.Builder) -> SparkSession.Builder:
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
    )


def local_session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("doctables")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    spark = tune(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
