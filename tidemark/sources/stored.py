"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def one_process(master: str) -> bool:
    """Whether all of Spark runs in the driver's process: `local` or `local[...]`, but not `local-cluster[...]`."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a new folder under /tmp if all of Spark runs in one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """df, computed now, written to the shared folder and read back: what several branches of a plan read is computed once,
    and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
