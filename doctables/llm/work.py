"""Tables written to shared storage, and components of a graph of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only under a local master."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="doctables-llm-"))
        root = context.getCheckpointDir()
    return f"{root}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the frame as Parquet to shared storage and read it back: a lost executor costs no rerun."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names, behind as many underscores as it takes for none of them to be a column of the frame."""
    taken, start = {c.lower() for c in df.columns}, "_"
    while any(f"{start}{n}".lower() in taken for n in names):
        start += "_"
    return [start + n for n in names]


def forget(df: DataFrame) -> None:
    """Delete the files of a saved frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) per linked node.

    component is the smallest node reachable. Alternates two steps until nothing
    changes: every node sends its larger neighbours to its smallest neighbour, then
    its smaller neighbours. Both are an aggregation and a join on a unique side, so
    a node with very many links is pre-aggregated and its join can be split. Links
    with a NULL end or from a node to itself say nothing and are left out.
    """
    stars = saved(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _mark(stars)
    while before[0]:
        both = stars.union(stars.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.join(lowest, "a").filter("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(lowest, "a")
            .filter("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(lowest)
        )
        after = saved(small.distinct())
        mark = _mark(after)
        forget(stars)
        stars = after
        if mark == before:
            break
        before = mark
    return (
        stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(stars.select("b", "b"))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )


def _mark(frame: DataFrame) -> tuple:
    """Number and checksum of the rows, the same for equal sets of rows."""
    row = frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)
