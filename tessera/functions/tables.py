"""Intermediate tables of iterative algorithms, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: cuts its lineage and survives lost executors. Uses the configured folder; sets one only where none is."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)
