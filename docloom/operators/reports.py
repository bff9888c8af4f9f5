"""Small reports over edges, nodes and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_relation(edges: DataFrame, known: list[tuple[int, str]] | None = None) -> DataFrame:
    """tier, relation, n_edges, weight; a `known` (tier, relation) without edges has a row too, with no edges and a null weight."""
    counts = edges.groupBy("tier", "relation").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))
    if not known:
        return counts
    names = edges.sparkSession.createDataFrame(known, "tier int, relation string")
    return counts.join(names, ["tier", "relation"], "full").select("tier", "relation", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "weight")


def per_year(rows: DataFrame, column: str = "sent_at", key: str = "message_key") -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(F.year(column).alias("year")).agg(F.countDistinct(key).alias("n_messages"))


def top(rows: DataFrame, by: str, n: int = 10, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), *ties).limit(n)


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(src, dst) with the names of nodes(entity_id, canonical) at both ends."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("entity_id").alias(end), F.col("canonical").alias(f"{end}_name")), end, "left")
    return edges


def band(value: Column, low: int = 150, high: int = 1500) -> Column:
    return value.between(low, high)


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, standard deviation, least, median, largest."""
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("least"), F.median(column).alias("median"), F.max(column).alias("largest"))
