"""Joins on ranges as equi-joins on bins: overlapping spans, and rows that lie close in time.

A plain inequality makes Spark compare all pairs of a key in one task. Here a key's rows are spread over bins of its range,
which also splits a key that holds a large part of all rows, and each pair is found in exactly one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key and bin from which on a group is dealt to several tasks.
GROUP_ROWS = 20_000
#: Width of a bin in mean spans: wider bins store fewer copies of a span and compare more pairs.
WIDTH = 4


def _named(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The row as one struct beside its keys, so that columns of both sides cannot clash."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(side), *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)])


def _bin(at: Column, width: Column) -> Column:
    return F.floor(at / width).cast("long")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """(left, right): structs of the rows with equal keys whose half-open spans overlap, left.start < right.end and
    right.start < left.end.

    A span stands in each bin it meets, and a pair counts in its first common bin. Without a width, bins are WIDTH times as wide as
    the mean span, so that a span stands in 1 + 1 / WIDTH bins in the mean where starts are spread evenly. Rows go with their keys, bounds and bin alone beside their own columns. Spans with a null bound, an end
    before their start, or a null key have no partner; empty spans overlap those that hold their place inside.
    """
    bound = lambda side, c: F.col(f"{side}.{c}").cast("long")
    sides = [_named(rows, keys, name).filter(bound(name, start) <= bound(name, end)) for rows, name in ((left, "left"), (right, "right"))]
    if width is None:
        sizes = [s.agg(F.count("*").alias("n"), F.sum(bound(name, end) - bound(name, start)).alias("s")).first() for s, name in zip(sides, ("left", "right"))]
        width = max(1, -(-WIDTH * sum(x.s or 0 for x in sizes) // max(1, sum(x.n for x in sizes))))
    wide = F.lit(width)
    first = lambda name: _bin(bound(name, start), wide)
    last = lambda name: F.greatest(_bin(bound(name, end) - 1, wide), first(name))
    a, b = (s.withColumn("_bin", F.explode(F.sequence(first(name), last(name)))) for s, name in zip(sides, ("left", "right")))
    on = [f"_key{i}" for i in range(len(keys))]
    met = a.join(b, [*on, "_bin"]).filter((bound("left", start) < bound("right", end)) & (bound("right", start) < bound("left", end)) & (F.col("_bin") == F.greatest(first("left"), first("right"))))
    return met.select("left", "right")


def micros(at: Column) -> Column:
    """Microseconds of a time stamp, with or without a zone."""
    return F.unix_micros(at.cast("timestamp"))


def close_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, seconds: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(left, right): structs of the rows with equal keys whose times are at most `seconds` apart, earlier or later.

    Times fall in buckets of that width; a left row meets the right rows of its own bucket and of both neighbours. Buckets of a key
    with more than `group_rows` left rows are salted: their left rows are dealt out, and right rows meet each salt. Rows with a
    null key or time have no partner.
    """
    on = [f"_key{i}" for i in range(len(keys))]
    span = max(1, round(seconds * 1_000_000))
    a = _named(left, keys, "left").withColumn("_t", micros(F.col(f"left.{time}"))).filter("_t IS NOT NULL").withColumn("_bucket", _bin(F.col("_t"), F.lit(span)))
    b = _named(right, keys, "right").withColumn("_u", micros(F.col(f"right.{time}"))).filter("_u IS NOT NULL")
    b = b.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _bin(F.col("_u"), F.lit(span)) + d)))
    crowded = a.groupBy(*on, "_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > group_rows)  # at most one in group_rows rows
    crowded = crowded.select(*on, "_bucket", F.ceil(F.col("_n") / group_rows).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    a = a.join(crowded, [*on, "_bucket"], "left").withColumn("_salt", F.pmod(F.xxhash64("left"), salts).cast("int")).drop("_salts")
    b = b.join(crowded, [*on, "_bucket"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    met = a.join(b, [*on, "_bucket", "_salt"]).filter(F.abs(F.col("_t") - F.col("_u")) <= span)
    return met.select("left", "right")
