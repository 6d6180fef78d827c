"""Small Spark helpers of the operators in this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only on one machine whose session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
        os.makedirs(at.removeprefix("file://"), exist_ok=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def table_parts(df: DataFrame, text_col: str, part_bytes: int) -> int:
    """A number of parts that grows with the measured bytes; the session's shuffle partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-text_bytes(df, text_col) // part_bytes))
