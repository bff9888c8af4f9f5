"""Mixing sources to target weights by capped water-filling.

Sources take shares of a word budget in proportion to their weights. A source whose share
would repeat its words more than `max_epochs` times is clamped there, and what it leaves goes
to the others by weight until none is above its clamp. The clamps met first are those with the
least capacity per unit of weight, so the fixed point needs one ordered pass over the sources,
not a loop: with the sources in order of capacity/weight, the level of the first source that
the remaining budget does not fill is everyone's level.

Every document then gets the whole repetitions of its source, and a seeded fraction of the
documents one more: documents stand in the order of a seeded hash, and those whose middle word
lies before the rest of the target are taken. A histogram of 4096 hash bins finds the bin where
this border lies; only the documents of that bin (1/4096 of a source) are ever put in order, so
a source holding a third of all rows needs no large sort.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last; equal
hashes (a repeated id) stand by the text's digest; rows equal in all of these are interchangeable;
sources of total size 0 get target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights are dealt to the sources in order, again and again.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
BIN_HEX = 3


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source."""
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_rank").asc())
    levels = (
        caps.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_after", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") * F.lit(float(share)) - F.col("_before")) / F.col("_after"))
        .withColumn("_k", F.row_number().over(order))
        .withColumn("_open", F.col("_level") < F.col("_cap") / F.col("_w"))
        .withColumn("_first", F.min(F.when(F.col("_open"), F.struct("_k", "_level"))).over(everything))
    )
    filled = F.col("_first").isNull() | (F.col("_k") < F.col("_first._k"))
    return levels.select("source", "source_size", F.when(filled, F.col("_cap")).otherwise(F.col("_first._level") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """The columns of `docs` (or those named in `keep`) with size, source_size, target, repeats and taken added.

    Older columns of those five names go.
    """
    kept = [c for c in keep or docs.columns if c not in ("size", "source_size", "target", "repeats", "taken")]
    rows = (
        docs.select(F.struct(*kept).alias("_row"), "doc_id", "source", "text")  # the row's own names cannot clash in there
        .withColumn("size", word_count(F.col("text")))
        .withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("_bin", F.substring("_h", 1, BIN_HEX))
        .withColumn("_tie", F.md5(F.coalesce(F.col("text"), F.lit(""))))
        .drop("text", "doc_id")
    )
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_bin_size"))
    plan = targets(bins.groupBy("source").agg(F.sum("_bin_size").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    # For each bin the words before it; the bin where they reach the rest of the target is the border.
    run = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = bins.withColumn("_end", F.sum("_bin_size").over(run)).withColumnsRenamed({"source": "_s", "_bin": "_b"})
    steps = ends.join(plan, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    steps = steps.withColumn("_start", F.col("_end") - F.col("_bin_size")).drop("_bin_size")
    # Joined on (source, bin), a hot source is spread over all its bins.
    placed = rows.join(steps, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b"))).drop("_s", "_b")
    at_border = (F.col("_start") < F.col("_rest")) & (F.col("_end") >= F.col("_rest"))
    apart = placed.filter(~at_border).withColumn("_extra", (F.col("_end") < F.col("_rest")).cast("int"))
    inside = Window.partitionBy("source").orderBy("_h", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_start") + F.sum("size").over(inside)
    near = placed.filter(at_border).withColumn("_extra", (2 * end - F.col("size") <= 2 * F.col("_rest")).cast("int"))
    both = apart.unionByName(near)
    repeats = F.col("_whole") + F.when(F.col("_rest") > 0, F.col("_extra")).otherwise(F.lit(0))
    return both.withColumn("repeats", repeats.cast("long")).select("_row.*", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeat_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs, with its own columns only, as often as it is taken."""
    mixed = mix(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text"), keep=["_doc"], **how)
    times = F.when(F.col("repeats") > 0, F.sequence(F.lit(1), F.col("repeats").cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.select("_doc", F.explode(times)).select("_doc.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
c AS (SELECT source, source_size, rk, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM r),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * CAST(1.5 AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, rk) AS k FROM c),
f AS (SELECT k AS k0, level AS level0 FROM l WHERE level < cap / w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN cap ELSE level0 * w END AS target FROM l LEFT JOIN f ON TRUE),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY d.h, md5(coalesce(d.text, '')) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
