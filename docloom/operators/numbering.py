"""Consecutive numbers in a total order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.workspace import cut_lineage


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with `out`, their place in the order from 0: ranges are sorted apart, and each starts where those before it end.

    The driver gets one count for each range.
    """
    held = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    places = held.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    starts, at = [], 0
    for r in sorted(places.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        starts.append((r["_range"], at))
        at += r["n"]
    first = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    return places.join(F.broadcast(first), "_range").withColumn(out, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")
