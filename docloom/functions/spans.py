"""Table functions that turn a text into rows of spans: used by lateral joins, and by name in SQL once registered.

A pattern's matches with their offsets have no native form. Each text is scanned whole, once, in Arrow batches; spans are
character offsets, so substring(text, start + 1, end - start) is the surface again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, udtf

from docloom.functions import fixed
from docloom.operators import retrieval

_NAME = re.compile(fixed.PROPER_NOUN)


@udtf(returnType="start int, end int, surface string", useArrow=True)
class CapitalisedSpans:
    """start, end, surface of each run of capitalised words in a text, without white space at its end."""

    def eval(self, text: str):
        for m in _NAME.finditer(text or ""):
            surface = m[0].rstrip()
            yield m.start(), m.start() + len(surface), surface


@udtf(returnType="start int, end int, surface string", useArrow=True)
class PatternSpans:
    """start, end, surface of each match of a pattern in a text; empty matches are none."""

    def __init__(self):
        self.held = {}

    def eval(self, text: str, pattern: str):
        if text is None or pattern is None:
            return
        if pattern not in self.held:
            self.held[pattern] = re.compile(pattern)
        for m in self.held[pattern].finditer(text):
            if m[0]:
                yield m.start(), m.end(), m[0]


@udtf(returnType="nth int, start int, end int, surface string", useArrow=True)
class LocatedSpans:
    """nth, start, end, surface of given surfaces in a text: each takes its first place that no earlier one has, exact, then
    stripped, then without case; -1 if there is none."""

    def eval(self, text: str, surfaces: list):
        wanted = [s for s in surfaces or [] if s is not None]
        for i, (s, at) in enumerate(zip(wanted, retrieval.locate(text or "", wanted))):
            yield i, at, at + len(s) if at >= 0 else -1, s


def register(spark: SparkSession) -> None:
    """capitalised_spans(text), pattern_spans(text, pattern) and located_spans(text, surfaces) for SQL: FROM chunks, LATERAL ..."""
    for name, made in (("capitalised_spans", CapitalisedSpans), ("pattern_spans", PatternSpans), ("located_spans", LocatedSpans)):
        spark.udtf.register(name, made)


def _lists(texts: pa.Array, found, surface: bool) -> pa.Array:
    """A list for each text of a batch: `found` gives (start, end) of the spans of a text."""
    texts = texts.to_pylist()
    held = [list(found(t)) if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, held)])
    flat = [pa.array([x[k] for spans in held for x in spans], pa.int32()) for k in (0, 1)]
    names = ["start", "end"]
    if surface:
        names, flat = [*names, "surface"], [*flat, pa.array([t[a:b] for t, spans in zip(texts, held) for a, b in spans], pa.string())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names))


def _column(text: str, found, surface: bool) -> Column:
    """Lists of spans of a text column, one call a batch: a table function is called, and its rows are made Arrow, text by text."""
    kind = "array<struct<start:int,end:int,surface:string>>" if surface else "array<struct<start:int,end:int>>"

    @arrow_udf(returnType=kind)
    def run(texts: pa.Array) -> pa.Array:
        return _lists(texts, found, surface)

    return run(F.col(text))


def capitalised(chunks: DataFrame, min_length: int = 6, surface: bool = True) -> DataFrame:
    """chunks(.., text) with start, end, surface: a row a run of capitalised words of at least `min_length` characters."""

    def found(text):
        for m in _NAME.finditer(text):
            end = m.start() + len(m[0].rstrip())
            if end - m.start() >= min_length:
                yield m.start(), end

    return chunks.select("*", F.inline(_column("text", found, surface)))


def matches(chunks: DataFrame, pattern: str, max_length: int | None = None) -> DataFrame:
    """chunks(.., text) with start, end: a row a match of a pattern that is not empty and has at most `max_length` characters."""
    held = re.compile(pattern)

    def found(text):
        return [s for s in (m.span() for m in held.finditer(text)) if s[0] < s[1] and (max_length is None or s[1] - s[0] <= max_length)]

    return chunks.select("*", F.inline(_column("text", found, False)))


def located(chunks: DataFrame, surfaces: str) -> DataFrame:
    """chunks(.., text, surfaces) with nth, start, end, surface and a note on those that are not found."""
    rows = chunks.lateralJoin(LocatedSpans(F.col("text").outer(), F.col(surfaces).outer()))
    return rows.withColumn("note", F.when(F.col("start") < 0, "unlocated"))


def document_mentions(chunks: DataFrame, min_length: int = 6) -> DataFrame:
    """chunks(chunk_id, doc_id, text, char_start, char_end) to mentions with their places in the chunk and in the document.

    chunk_id, doc_id, start, end, surface, norm, doc_start, doc_end, in_header: a mention inside the prepended header has
    -1 for its document offsets.
    """
    rows = capitalised(chunks, min_length)
    place = retrieval.document_span(F.col("char_start"), F.col("char_end"), F.col("text"), F.col("start"), F.col("end"))
    norm = F.lower(F.regexp_replace(F.regexp_replace("surface", r"[^\w\s]", " "), r"\s+", " "))
    rows = rows.withColumn("_p", place).select("chunk_id", "doc_id", "start", "end", "surface", norm.alias("norm"), "_p.doc_start", "_p.doc_end", F.col("_p.note").isNotNull().alias("in_header"))
    return rows
