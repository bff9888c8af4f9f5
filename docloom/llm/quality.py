"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics describe a whole text: shares of character classes, word lengths, repetition of
words, word pairs and lines, shares of capitalised, symbol-ended and separator words, and how
well the text compresses. Trees are trained on the driver on at most `MAX_TRAIN` labelled rows
(those with the least hash of their id), flattened into arrays and sent to the executors.

Defined cases: a null text is scored as an empty one, whose statistics are all 0; repeated rows
score alike; several labels of one id all count; without labels the score is 0.5, with one class
its smoothed share; an empty table gives an empty result. Columns of the input other than doc_id
and text never reach the score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import hgb
from docloom.llm.common import byte_groups

MAX_TRAIN = 20_000

_CLASS = np.full(256, 8, np.uint8)  # other printable ASCII
_CLASS[:32] = 9
_CLASS[127] = 9
_CLASS[128:] = 7
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 5
_CLASS[[ord("!"), ord("?")]] = 6
N_FEATURES = 25


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    data = text.encode("utf-8", "replace")
    n = len(data)
    share = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10) / n
    words = text.split()
    k = len(words)
    if not k:
        return [np.log1p(n), *share, *[0.0] * (N_FEATURES - 11)]
    lengths = list(map(len, words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / (k - 1) if k > 1 else 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    mean = sum(lengths) / k
    clean = sum(map(str.isalpha, words))
    return [
        np.log1p(n),
        *share,
        np.log1p(k),
        mean,
        max(lengths),
        (sum(x * x for x in lengths) / k - mean * mean) ** 0.5 if k > 1 else 0.0,
        len(counts) / k,
        counts.most_common(1)[0][1] / k,
        pairs,
        clean / k,
        sum(map(str.isupper, words)) / k,
        sum(map(str.istitle, words)) / k,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?!" for w in words) / k,
        len(set(lines)) / max(1, len(lines)),
        k / max(1, len(lines)),
        len(zstandard.ZstdCompressor(level=1).compress(data)) / n,
    ]


def features(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), N_FEATURES)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learnable, limit: int = MAX_TRAIN) -> DataFrame:
    """At most `limit` (text, y) rows: those of the labelled ids that may be learnt from, least hash first."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("_id").isNotNull() & learnable(F.col("_id")))
        .orderBy(F.xxhash64("_id"), "_id", "y")
        .limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "y")  # at most `limit` pairs of numbers


def train(docs: DataFrame, labels: DataFrame, learnable) -> hgb.Trees:
    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(features(b.column(0).to_pylist())), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = training_rows(docs, labels, "quality", learnable).mapInArrow(measured, "x array<double>, y int").toArrow()
    x = np.array(rows.column(0).to_pylist(), np.float64).reshape(-1, N_FEATURES)
    y = rows.column(1).to_numpy()
    order = np.lexsort([*x.T, y])  # rows come in any order; sums must not depend on it
    return hgb.fit(x[order], y[order])


def score(docs: DataFrame, model: hgb.Trees) -> DataFrame:
    """The columns of `docs` with `_score` added; the model travels with the task (some 10 KB)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType(), False)])

    def scored(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            out = []
            for lo, hi in byte_groups(texts.to_pylist()):
                out.append(model.score(features(texts.slice(lo, hi - lo).to_pylist())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*b.schema.names, "_score"])

    return docs.mapInArrow(scored, schema)


def may_learn(doc_id):
    """crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, may_learn))
    return scored.select(
        "doc_id",
        F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches 0.5, with their own columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score(inner, train(docs, labels, may_learn)).filter("_score >= 0.5").select("row.*")
