"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Only where the session names none and runs in one JVM (tests) is a temporary folder set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0] if held.get().count("/") > 3 else held.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="docloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


class Workspace:
    """A folder of written intermediate tables under the shared folder.

    A written table cuts lineage and survives the loss of executors. The folder goes
    when the session's process ends; `drop` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._end = atexit.register(_forget, weakref.ref(spark), self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write_bucketed(self, df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
        """A table dealt out by the key, so that joins on it move only the other side; and its name, to be dropped."""
        table = f"docloom_{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(table)
        return self.spark.table(table), table

    def drop(self, name: str) -> None:
        remove_path(self.spark, f"{self.path}/{name}")


def _forget(spark_ref, path: str) -> None:
    spark = spark_ref()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            remove_path(spark, path)
    except Exception:  # the JVM may be gone at exit; nothing can be cleaned then
        pass


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def record_batches(rows, names, types, size: int = 4000):
    """Arrow batches of at most `size` rows from an iterator of tuples; at least one, perhaps empty."""
    part: list[tuple] = []
    first = True
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield _batch(part, names, types)
            part, first = [], False
    if part or first:
        yield _batch(part, names, types)


def _batch(part, names, types) -> pa.RecordBatch:
    columns = zip(*part) if part else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def byte_groups(texts, limit: int = 2_000_000):
    """Yield (start, end) ranges of consecutive texts of about `limit` characters; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def utf8_groups(texts: pa.Array, limit: int = 2_000_000):
    """Yield (first, last, bytes, offsets) of consecutive texts of about `limit` bytes as numpy arrays over Arrow's own
    buffers; a null text is an empty one, a longer text is alone. Text i of a group is bytes[offsets[i]:offsets[i + 1]].
    """
    if not len(texts):
        return
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, where, held = texts.buffers()
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi
