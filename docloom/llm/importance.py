"""Resampling documents towards a target distribution by hashed word n-grams.

Features are all runs of 1 to 3 consecutive words; a feature's bucket is the crc32 of its bytes modulo BUCKETS.
A bucket gains by how much commoner it is in the target texts than in the documents; a document weighs the
sum of gains over its features, and documents are drawn without replacement by weight plus seeded Gumbel noise.

Hashing is a byte automaton over Arrow's UTF-8 buffers. A lookup table tells word bytes from others, differences of
neighbouring flags give the bounds of all words of a group of texts, and a table-driven CRC advances from all
word starts at once, one byte of each a step. Words over PIECE bytes are cut into pieces with starts of their own. A
CRC is linear, so pieces, and words that follow each other, are joined by tables that advance a state over zero bytes;
so each byte is met once, for all three lengths of runs and however long a word is.

Counts of all documents and of all target texts are summed bucket by bucket in Spark; the driver gets BUCKETS numbers of
each. Weights are made in a second pass, and places are numbered by sorted ranges.

Defined cases: a null text has no words; a null id counts as an empty one in the noise; of equal scores the smaller id
comes first (a null id before all), then the smaller weight; repeated rows are rows of their own; very long texts and words
are worked on whole, in runs of words; an empty target gives gains of the documents' counts alone; an empty table
gives an empty result. Columns of the input named like those added go; all others are kept apart and cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Workspace, utf8_groups
from docloom.operators.numbering import numbered

BUCKETS = 10_000
RUN = 200_000
PIECE = 32
_ONES = np.uint32(0xFFFFFFFF)
_SPACE = np.uint32(0x20)


def _word_bytes() -> np.ndarray:
    """Digits, letters and all bytes of characters beyond ASCII."""
    held = np.zeros(256, np.uint8)
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        held[ord(a) : ord(b) + 1] = 1
    held[128:] = 1
    return held


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


IS_WORD = _word_bytes()
LOWER = np.arange(256, dtype=np.uint32)
LOWER[ord("A") : ord("Z") + 1] += 32
CRC = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return CRC[(state ^ byte) & 255] ^ (state >> 8)


def _zero_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables that advance a state, a byte of it at a time, over 0 to PIECE - 1 zero bytes, and over PIECE * 2^i of them."""
    bytes_of = np.arange(4, dtype=np.uint32)[:, None] * 8
    at = np.arange(256, dtype=np.uint32)[None, :] << bytes_of
    few = [at]
    for _ in range(PIECE):
        few.append(_step(few[-1], np.uint32(0)))
    many = [few.pop()]
    for _ in range(40):
        many.append(_through(many[-1], many[-1]))
    return np.stack(few), np.stack(many)


def _through(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


_FEW, _MANY = _zero_tables()
_FLAT = [np.ascontiguousarray(_FEW[:, i]).reshape(-1) for i in range(4)]


def over_zeros(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States after n further zero bytes each."""
    at = (n % PIECE) * 256
    out = _FLAT[0][at + (state & 255)] ^ _FLAT[1][at + ((state >> 8) & 255)] ^ _FLAT[2][at + ((state >> 16) & 255)] ^ _FLAT[3][at + (state >> 24)]
    rest, bit = n // PIECE, 0
    while rest.any():
        rows = np.flatnonzero(rest & 1)
        out[rows] = _through(_MANY[bit], out[rows])
        rest, bit = rest >> 1, bit + 1
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a text's end ends a word."""
    flag = IS_WORD[data]
    before, after = np.zeros_like(flag), np.zeros_like(flag)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = 0
    after[inner - 1] = 0
    return np.flatnonzero(flag > before), np.flatnonzero(flag > after) + 1


def word_states(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC register, begun with 0, after each word in lower case."""
    pieces = (sizes + PIECE - 1) // PIECE
    if pieces.max(initial=0) > 1:  # the first piece of a word is the short one
        word = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = sizes - PIECE * (pieces - 1)
        length = np.where(nth == 0, first[word], PIECE)
        begin = starts[word] + np.where(nth == 0, 0, first[word] + PIECE * (nth - 1))
        part = over_zeros(_advance(data, begin, length), PIECE * (pieces[word] - 1 - nth))
        return np.bitwise_xor.reduceat(part, np.cumsum(pieces) - pieces)
    return _advance(data, starts, sizes)


def _advance(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """From all starts at once; those with most bytes come first, so that what is still under way is a prefix."""
    order = np.argsort((PIECE - sizes).astype(np.uint8), kind="stable")
    at, live = starts[order], len(starts) - np.searchsorted(sizes[order][::-1], np.arange(PIECE), "right")
    state = np.zeros(len(starts), np.uint32)
    for k, n in enumerate(live):
        if not n:
            break
        state[:n] = _step(state[:n], LOWER[data[at[:n] + k]])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, run: int = RUN):
    """Yield (text of each word, its buckets, mask) for runs of words: buckets (3, words) of the features that begin there,
    and which of them exist."""
    starts, ends = word_bounds(data, offsets)
    texts = np.searchsorted(offsets, starts, "right") - 1
    for lo in range(0, len(starts), run):
        hi = min(lo + run, len(starts))
        up = min(hi + 2, len(starts))
        sizes = ends[lo:up] - starts[lo:up]
        alone = word_states(data, starts[lo:up], sizes)
        states = [alone ^ over_zeros(np.full(up - lo, _ONES), sizes)]
        text = texts[lo:up]
        held = [np.ones(up - lo, bool)]
        for k in (1, 2):
            joined = np.zeros(up - lo, np.uint32)
            same = np.zeros(up - lo, bool)
            if up - lo > k:
                joined[:-k] = over_zeros(_step(states[-1][:-k], _SPACE), sizes[k:]) ^ alone[k:]
                same[:-k] = text[k:] == text[:-k]
            states.append(joined)
            held.append(same)
        yield text[: hi - lo], (np.stack(states)[:, : hi - lo] ^ _ONES) % BUCKETS, np.stack(held)[:, : hi - lo]


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task gives at most BUCKETS rows."""

    def counted(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, data, offsets in utf8_groups(b.column(0)):
                for _, bucket, held in features(data, offsets):
                    total += np.bincount(bucket[held], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """`_row` (the columns to keep), doc_id, n_words, n_features, weight; the gains travel with the task (80 KB)."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "doc_id", "text")
    names = ["_row", "doc_id", "n_words", "n_features", "weight"]
    schema = T.StructType([inner.schema["_row"], inner.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in names[2:]]])

    def weighed(batches):
        for b in batches:
            words, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for first, last, data, offsets in utf8_groups(b.column(2)):
                for text, bucket, held in features(data, offsets):
                    words[first:last] += np.bincount(text, minlength=last - first)
                    each = np.where(held, gain[bucket], 0).sum(0)
                    weight[first:last] += np.bincount(text, each, minlength=last - first).astype(np.int64)  # whole numbers below 2^53
            runs = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words), pa.array(runs), pa.array(weight)], names)

    return inner.mapInArrow(weighed, schema)


ADDED = ("n_features", "weight", "score", "rank")


def rank(spark: SparkSession, docs: DataFrame, target: DataFrame, keep: list[str] | None = None, share: tuple[int, int] = (5, 100), min_words: int = 20, seed: int = 42) -> DataFrame:
    """The columns of docs (or those in `keep`) with n_features, weight, score and rank: 1, 2, .. for the drawn, else null.

    `target` has a column text. Of the documents with at least `min_words` words the given share is drawn.
    """
    kept = [c for c in keep or docs.columns if c not in ADDED]
    work = Workspace(spark, "importance")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / F.lit(4294967296.0))))
    scored = work.write(weigh(docs, gain, kept).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count() * share[0] // share[1]
    placed = numbered(able, [F.col("score").desc(), F.col("doc_id"), F.col("weight")], "_place")
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    both = placed.withColumn("rank", F.when(F.col("_place") < n, F.col("_place") + 1).cast("long")).select(*rest.columns).unionByName(rest)
    return both.select("_row.*", *ADDED)


def sample(spark: SparkSession, docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents themselves, with their own columns only."""
    inner = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    return rank(spark, inner, target, keep=["_doc"], **how).filter("rank IS NOT NULL").select("_doc.*")


#: CRCs advance byte by byte in a recursive query, over the different features.
ORACLE_SQL = rf"""
WITH RECURSIVE tab AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
a AS (SELECT doc_id, 'd' AS side, coalesce(text, '') AS text FROM documents UNION ALL SELECT item_id, 'b', coalesce(text, '') FROM benchmark),
w AS (SELECT doc_id, side, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM a),
f AS (SELECT doc_id, side, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS feature
      FROM (SELECT doc_id, side, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n))),
u AS MATERIALIZED (SELECT feature, lower(hex(encode(feature))) AS h FROM f GROUP BY 1),
r AS (SELECT feature, h, CAST(1 AS BIGINT) AS k, CAST(4294967295 AS BIGINT) AS c FROM u
      UNION ALL
      SELECT feature, h, k + 2, xor(c >> 8, v) FROM r JOIN tab ON i = xor(c, CAST((strpos('0123456789abcdef', substr(h, k, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, k + 1, 1)) - 1 AS BIGINT)) & 255 WHERE k < length(h)),
x AS (SELECT feature, xor(c, CAST(4294967295 AS BIGINT)) % {BUCKETS} AS bucket FROM r WHERE k > length(h)),
g AS (SELECT doc_id, side, bucket FROM f JOIN x USING (feature)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM g GROUP BY 1),
z AS (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS s_all, CAST(coalesce(sum(t), 0) AS BIGINT) AS t_all FROM n),
q AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * (t_all + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM n, z),
y AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM g JOIN q USING (bucket) WHERE side = 'd' GROUP BY 1),
e AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS m, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM w WHERE side = 'd'),
o AS (SELECT e.doc_id, m, m + greatest(m - 1, 0) + greatest(m - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM e LEFT JOIN y ON e.doc_id = y.doc_id),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE m >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM p) THEN rank END AS rank FROM o LEFT JOIN p ON o.doc_id = p.doc_id
"""
