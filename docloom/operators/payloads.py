"""What language models answer, as mentions: payloads are parsed without trust, and every failure is a row.

A payload is a JSON object with a list `entities` of objects with surface, type and verdict. Values are parsed as VARIANT, so that one
item of another shape does not spoil the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import spans
from docloom.operators import retrieval


def failures(rows: DataFrame) -> DataFrame:
    """rows(chunk_id, payload) to (chunk_id, reason): no payload, malformed JSON, or no list of entities."""
    parsed = _parsed(rows)
    reason = F.when(F.col("payload").isNull(), "missing").when(F.col("_v").isNull(), "malformed").otherwise("no entities")
    return parsed.filter("_items IS NULL").select("chunk_id", reason.alias("reason"))


def _parsed(rows: DataFrame) -> DataFrame:
    value = F.try_parse_json(F.col("payload"))
    return rows.withColumn("_v", value).withColumn("_items", F.try_variant_get("_v", "$.entities", "array<variant>"))


def mentions(rows: DataFrame) -> DataFrame:
    """rows(chunk_id, doc_id, text, char_start, char_end, payload) to mentions with their places.

    chunk_id, doc_id, nth, start, end, doc_start, doc_end, surface, type, note. Items of another shape and implausible surfaces are
    left out; of a chunk's surfaces each takes its first place that none before it has. What is found nowhere stays, with
    -1 for its places, so that it is not mistaken for nothing; of others the note is the place or the model's verdict.
    """
    item = lambda name: F.try_variant_get("_item", f"$.{name}", "string")
    flat = _parsed(rows).filter("_items IS NOT NULL").select("chunk_id", F.posexplode("_items").alias("_i", "_item"))
    read = flat.select("chunk_id", "_i", F.regexp_replace(item("surface"), r"^\s+|\s+$", "").alias("surface"), F.upper(item("type")).alias("type"), item("verdict").alias("verdict"))
    good = read.filter(F.coalesce(retrieval.is_plausible(F.col("surface"), F.col("type")), F.lit(False)))
    listed = good.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("_i", "surface", "type", "verdict"))).alias("_found"))
    held = rows.select("chunk_id", "doc_id", "text", "char_start", "char_end").join(listed, "chunk_id").withColumn("_surfaces", F.transform("_found", lambda x: x["surface"]))
    placed = spans.located(held, "_surfaces").withColumn("_f", F.get("_found", F.col("nth")))
    place = retrieval.document_span(F.col("char_start"), F.col("char_end"), F.col("text"), F.col("start"), F.col("end"))
    lost = F.col("start") < 0
    placed = placed.withColumn("_p", place).withColumn("surface", F.when(lost, F.col("surface")).otherwise(F.expr("substring(text, start + 1, end - start)")))
    note = F.when(lost, "unlocated").otherwise(F.coalesce(F.col("_p.note"), F.col("_f.verdict")))
    at = lambda name: F.when(lost, F.lit(-1)).otherwise(F.col(f"_p.{name}"))
    return placed.select("chunk_id", "doc_id", "nth", "start", "end", at("doc_start").alias("doc_start"), at("doc_end").alias("doc_end"), "surface", F.col("_f.type").alias("type"), note.alias("note"))
