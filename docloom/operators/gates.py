"""Filters that count what they let through and what they drop, in the pass that does the work.

The counts are observed metrics: they are there once an action has run over the kept rows, and cost no second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.operators import edges


class Gates:
    """A chain of named filters over one table."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.seen: list[tuple[str, Observation]] = []

    def keep(self, name: str, test: Column) -> Gates:
        """Only rows that pass the test go on; a null test does not pass."""
        passed = F.coalesce(test, F.lit(False))
        watch = Observation(f"{name}-{len(self.seen)}")
        watched = self.rows.observe(watch, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(passed.cast("long")), F.lit(0)).alias("kept"))
        self.rows = watched.filter(passed)
        self.seen.append((name, watch))
        return self

    def counts(self, spark: SparkSession) -> DataFrame:
        """(gate, rows, kept, dropped) of every gate, after an action over `rows`."""
        found = [(name, watch.get["rows"], watch.get["kept"]) for name, watch in self.seen]
        return spark.createDataFrame(found, "gate string, rows long, kept long").withColumn("dropped", F.col("rows") - F.col("kept"))


def routing_gate(rows: DataFrame) -> Gates:
    """Mail rows without routing blocks."""
    return Gates(rows).keep("routing", edges.is_mail())


def mention_gates(mentions: DataFrame, noisy: DataFrame) -> Gates:
    """mentions(entity_id, in_header, ..) that are linked, in the body, and of no noisy(entity_id) entity."""
    marked = mentions.join(noisy.select("entity_id").distinct().withColumn("_noisy", F.lit(True)), "entity_id", "left")
    gates = Gates(marked).keep("linked", F.col("entity_id").isNotNull()).keep("body", ~F.coalesce("in_header", F.lit(False))).keep("clean", F.col("_noisy").isNull())
    gates.rows = gates.rows.drop("_noisy")
    return gates
