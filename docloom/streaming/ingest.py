"""Incremental ingestion: documents arrive as files, only new ids are worked on, results are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def start_ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform, key: str = "doc_id"):
    """A query that reads new parquet files of `source`, drops keys already in `sink`, and appends transform(rows).

    It takes what is there and stops; started again it goes on from its checkpoint. A batch that is run twice adds
    nothing, because its keys are then in the sink.
    """

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        done = session.read.parquet(sink) if _exists(session, sink) else None
        fresh = rows.dropDuplicates([key])
        transform(pending(fresh, done, key) if done is not None else fresh).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events(ts, event_type) to counts per window; works on streams, where late rows are dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """events(ts, user_id) to one row per user and session."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")
