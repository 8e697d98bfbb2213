"""Compute a panel once when several steps read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    On a cluster a session without such a folder is an error; only where driver and executors are one process (a local master)
    does a folder of its own stand in.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return f"{_base(spark).rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder: lost executors then re-read files instead of recomputing the lineage.

    Set spark.cleaner.referenceTracking.cleanCheckpoints to have the files deleted with the DataFrame.
    """
    _base(df.sparkSession)
    return df.checkpoint()
