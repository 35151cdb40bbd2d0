"""Cut lineage into shared storage, so that a lost executor costs no rerun."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get(
            "spark.checkpoint.dir", None
        )
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="doctables-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
