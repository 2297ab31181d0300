"""Intermediate tables that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's folder; a folder of this machine only where a local session names none.

    Its partitions, and the order of the rows in them, are those of df whenever it is read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsloom-"))
    return df.checkpoint()
