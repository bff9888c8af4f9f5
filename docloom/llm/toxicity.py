"""Toxicity by compression distance between two zstandard dictionaries.

A window of text is compressed twice, once with a dictionary of toxic text and once with one of
ordinary text; the bytes that the toxic one saves are the window's gain. A window is one word (up
to 48 characters) in a frame of bytes that ends both dictionaries, so that even a short word makes
a compressed block and the difference is due to the word alone. Words met before are looked up.

Training, on at most MAX_TRAIN labelled rows. The ordinary dictionary holds the words of ordinary
documents that save most (frequency times length). Labels are of whole documents, of which toxic
passages are a small part; so the toxic dictionary holds those word beginnings and words whose
share of toxic documents exceeds their share of ordinary ones most significantly (likelihood
ratio). The strongest come last, where a match is cheapest.

Calibration. A document is described by the share and number of its windows whose gain reaches
each of several thresholds; small boosted trees fitted on the same rows turn them into a
probability.

Defined cases: a null text or one without words has no windows and is scored as such; repeated
rows score alike; several labels of one id all count; without labels the score is 0.5, with one
class its smoothed share; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import hgb
from docloom.llm.common import Workspace, record_batches
from docloom.llm.quality import training_rows

MAX_TRAIN = 8_000
ORDINARY_BYTES = 6_000
TOXIC_BYTES = 4_000
LEVEL = 13
STEPS = (2, 3, 4, 5, 6, 8)
SIGNIFICANT = 20.0
CANDIDATES = 20_000
KEPT_WORDS = 200_000
_FRAME = b"|<0123456789abcdefghijklmnopqrstuvwxyz>|"
_WORD = re.compile(r"\w{1,48}")


def _beginnings(text: str) -> set[str]:
    """The words of a text with a space on either side, and their beginnings of 4 to 13 characters."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        s = " " + w
        out.update(s[:k] for k in range(5, min(len(s), 14) + 1))
        out.add(s + " ")
    return out


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of two shares a/n and b/m against their common share."""
    def part(k, n, p):
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (a + b) / (n + m)
    return 0.0 if p in (0.0, 1.0) else 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))


def _fill(strings, size: int) -> bytes:
    """The first strings that are not part of earlier ones, up to `size` bytes, the first at the end."""
    chosen, held, n = [], "", 0
    for s in strings:
        if s in held:
            continue
        n += len(s.encode())
        if n > size:
            break
        chosen.append(s)
        held += s
    return "".join(reversed(chosen)).encode()


class Gains:
    """Word to the bytes that the toxic dictionary saves over the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary, self.known = self._compressor(toxic), self._compressor(ordinary), {}

    @staticmethod
    def _compressor(content: bytes):
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        held = zstandard.ZstdCompressionDict(content + _FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def __getitem__(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            window = f" {word} ".encode("utf-8", "replace") + _FRAME
            got = self.known[word] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return got

    def describe(self, text: str | None) -> list[float]:
        words = _WORD.findall((text or "").lower())
        if not words:
            return [0.0] * (2 * len(STEPS) + 3)
        counts = Counter(map(self.__getitem__, words))
        n = len(words)
        at = [sum(c for g, c in counts.items() if g >= s) for s in STEPS]
        return [math.log1p(n), float(max(counts)), sum(g * c for g, c in counts.items() if g > 2) / n, *(a / n for a in at), *(math.log1p(a) for a in at)]


def _counted(rows: DataFrame) -> DataFrame:
    """(kind, string, in toxic, in ordinary): documents per beginning ('b') and occurrences per ordinary word ('w')."""

    def counts(batches):
        begin, words, docs = Counter(), Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0), b.column(1)):
                text, y = text.as_py() or "", y.as_py()
                docs[y] += 1
                begin.update((s, y) for s in _beginnings(text))
                if y == 0:
                    words.update(_WORD.findall(text.lower()))
                if len(begin) > 500_000:
                    yield from (("b", s, c if y else 0, 0 if y else c) for (s, y), c in begin.items())
                    begin.clear()
        yield from (("b", s, c if y else 0, 0 if y else c) for (s, y), c in begin.items())
        yield from (("w", s, 0, c) for s, c in words.items())
        yield "n", "", docs[1], docs[0]

    def run(batches):
        yield from record_batches(counts(batches), ["kind", "s", "a", "b"], [pa.string(), pa.string(), pa.int64(), pa.int64()])

    return rows.mapInArrow(run, "kind string, s string, a long, b long").groupBy("kind", "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learnable):
    """(toxic dictionary, ordinary dictionary, trees)."""
    work = Workspace(spark, "toxicity")
    rows = work.write(training_rows(docs, labels, "toxic", learnable, MAX_TRAIN), "rows")
    counted = work.write(_counted(rows), "counted")
    sizes = counted.filter("kind = 'n'").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    n, m = sizes.a or 0, sizes.b or 0
    toxic = ordinary = b""
    if n and m:
        likely = counted.filter((F.col("kind") == "b") & (F.col("a") >= 3) & (F.col("a") / n > 2 * F.col("b") / m))
        # The most frequent candidates only: a share among toxic documents too small for them is not significant.
        likely = likely.orderBy((F.col("a") / n - F.col("b") / m).desc(), "s").limit(CANDIDATES).collect()
        ranked = sorted(((_ratio(r.a, n, min(r.b, m), m), r.s) for r in likely), key=lambda x: (-x[0], x[1]))
        toxic = _fill((s for v, s in ranked if v > SIGNIFICANT), TOXIC_BYTES)
        common = counted.filter("kind = 'w'").orderBy((F.col("b") * F.length("s")).desc(), "s").limit(4 * ORDINARY_BYTES).collect()
        ordinary = _fill((" " + r.s for r in common), ORDINARY_BYTES)

    def described(batches):
        gains = Gains(toxic, ordinary)
        for b in batches:
            x = [gains.describe(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    found = rows.mapInArrow(described, "x array<double>, y int").toArrow()
    x, y = np.array(found.column(0).to_pylist(), np.float64).reshape(-1, 2 * len(STEPS) + 3), found.column(1).to_numpy()
    order = np.lexsort([*x.T, y])
    return toxic, ordinary, hgb.fit(x[order], y[order], trees=50, depth=3, rate=0.15, min_rows=8)


def score(docs: DataFrame, toxic: bytes, ordinary: bytes, trees: hgb.Trees) -> DataFrame:
    """The columns of docs with `_score` added; dictionaries and trees are some 20 KB."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType(), False)])
    at = docs.columns.index("text")

    def run(batches):
        gains = Gains(toxic, ordinary)
        for b in batches:
            x = np.array([gains.describe(t.as_py()) for t in b.column(at)], np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees.score(x) if b.num_rows else np.zeros(0))], schema.names)

    return docs.mapInArrow(run, schema)


def may_learn(doc_id):
    """crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), *train(spark, docs, labels, may_learn))
    return scored.select(
        "doc_id",
        F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"),
    )
