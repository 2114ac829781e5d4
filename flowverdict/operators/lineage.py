"""Cutting the lineage of tables that iterative jobs read again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of the session and read back."""
    return written(df, "checkpoint")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: later reads prune its columns, and a
    lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the same partitions and order: for fits that read their input
    several times and draw by partition."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession, "fit"))
    return df.checkpoint()


def shared_folder(spark, name: str) -> str:
    """A new folder for the files of one job, on the checkpoint storage of the session.

    The storage is what the cluster names in ``spark.checkpoint.dir``. Only a local session
    without the setting gets a temporary folder; elsewhere that would be another folder on
    every machine, so a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            known = context._jsc.sc().getCheckpointDir()
        folder = known.get()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
