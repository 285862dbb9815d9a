"""Keeping a table that an iterative job reads many times."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keep_for_reuse(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder named by ``spark.checkpoint.dir``; without one, cache with the lineage kept.

    Both survive the loss of executors: a checkpoint is read back, a lost cache block is computed again.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return df.checkpoint()
    return df.persist()
