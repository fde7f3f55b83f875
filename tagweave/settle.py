"""Cutting of long plans in jobs of many steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new path below the folder of spark.checkpoint.dir, which executors share; what is written there goes when the process ends."""
    _checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    atexit.register(_delete, path)
    return path


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is going down; the folder is a scratch folder
            return


def _checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder, where it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="tagweave-"))


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir, which executors share.

    Where it is unset, a temporary folder is taken with a local master, as in tests; on a cluster that is an error.
    """
    _checkpoints(df.sparkSession)
    return df.checkpoint()
