"""Where intermediate tables go: the folder that the session shares with its executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ensure(spark: SparkSession) -> str:
    """The session's checkpoint folder; a session of one JVM that names none gets its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="docloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the session's shared folder."""
    _ensure(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_ensure(spark)}/{name}-{uuid.uuid4().hex}"
