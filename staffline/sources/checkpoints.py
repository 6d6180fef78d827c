"""Lineage is cut with reliable checkpoints in the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in spark.checkpoint.dir; without that setting a temporary folder serves, on one machine only."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
        if not at and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at or f"file://{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()
