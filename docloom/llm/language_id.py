"""Language identification by error-correcting output codes over byte n-grams.

Every learnt language gets a codeword of bits; up to 5 languages have all different ways of parting them in two, more
have the best of some seeded draws of about 10 log2(languages) bits. For each bit a binary classifier tells the
languages with a 1 from those with a 0: a linear one over hashed n-grams of 1 to ORDERS bytes, whose weights are log
ratios of the mean frequencies on either side, languages counting alike however many documents they have. A text's margin
for a bit is the sum over its n-grams, divided by ORDERS because n-grams overlap.

Decoding adds, for each codeword, the logistic losses of the margins against its bits, weighted by how often the classifier of
the bit was right on learnt documents of the language. The codeword with the least loss is chosen, the score is its
share of exp(-loss), and a text is ambiguous where that share is not AMBIGUOUS ahead of the next one's.

Nothing is sampled: n-grams are counted in all documents that may be learnt from, and so are the hits of each bit. The
driver gets BUCKETS numbers and two numbers a bit for each language; it is made for up to some thousand languages.

N-grams are taken over Arrow's UTF-8 buffers: ASCII letters count as small ones, all other ASCII as a space, and an n-gram does
not cross from one text into the next. Texts of any length are worked on whole, in slices of SLICE bytes.

Defined cases: a null text or one without a letter is `und` with score 0, ambiguous; a null language teaches nothing; repeated
rows count each and score alike; equal losses go to the language that is least by code point; without a language to
learn all is `und`; with one only, that one, with score 1; a document without an id is neither learnt from nor held out; an
empty table gives an empty result. lang, source and doc_id never reach a prediction, other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import utf8_groups

BUCKETS = 8192
ORDERS = 3
SMOOTHING = 0.5
AMBIGUOUS = 0.5
SLICE = 1_000_000
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[ord("A") + _c] = _FOLD[ord("a") + _c] = ord("a") + _c


def codewords(n: int, seed: int = 7, draws: int = 200) -> np.ndarray:
    """(n, bits) of +1 and -1: no bit is the same for all, no two bits part the languages in the same way."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        part = np.arange(1, 2 ** (n - 1))
        return np.where((part[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    bits, rng = math.ceil(10 * math.log2(n)), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(draws):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code *= code[0]  # a bit and its opposite are the same
        code = np.unique(code[:, np.abs(code.sum(0)) < n], axis=1)
        distance = (code.shape[1] - code.astype(np.int32) @ code.T) // 2
        least = distance[~np.eye(n, dtype=bool)].min()
        if least > apart:
            best, apart = code, least
    return best


def grams(data: np.ndarray, offsets: np.ndarray):
    """Yield (text, bucket) arrays: the n-grams of each order that begin in a slice of the bytes."""
    sizes = np.diff(offsets)
    for lo in range(0, len(data), SLICE):
        hi = min(lo + SLICE, len(data))
        up = min(hi + ORDERS - 1, len(data))
        folded = _FOLD[data[lo:up]]
        a, b = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, up, "left")
        held = np.minimum(offsets[a + 1 : b + 1], up) - np.maximum(offsets[a:b], lo)
        text = np.repeat(np.arange(a, b), held) if len(sizes) > 1 else np.zeros(up - lo, np.int64)
        value = np.zeros(hi - lo, np.uint32)
        for k in range(ORDERS):
            m = min(hi - lo, up - lo - k)  # the last n-grams of the last text end before
            if m <= 0:
                break
            value = value[:m] * np.uint32(257) + folded[k : k + m] + np.uint32(1)
            inside = text[k : k + m] == text[:m]
            mixed = value * np.uint32(2654435761)
            yield text[:m][inside], ((mixed >> 16) % BUCKETS)[inside]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) numbers of n-grams."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    for text, bucket in grams(data, offsets):
        out += np.bincount(text * BUCKETS + bucket, minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def _groups(texts: pa.Array, rows: int = 256):
    """Groups of few texts each, as each text has a row of counts."""
    for lo in range(0, len(texts), rows):
        for first, last, data, offsets in utf8_groups(texts.slice(lo, rows), SLICE):
            yield lo + first, lo + last, data, offsets


@dataclass
class Model:
    """`code` (languages, bits), `weight` (BUCKETS, bits), `trust` (languages, bits)."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return text_counts(data, offsets).astype(np.float32) @ self.weight / ORDERS

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, ambiguity of each row of margins."""
        loss = np.empty((len(margins), len(self.languages)))
        for i, code in enumerate(self.code):
            loss[:, i] = (np.logaddexp(0, -code * margins.astype(np.float64)) * self.trust[i]).sum(1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(share, 1)
        second = ranked[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        score = share[np.arange(len(best)), best]
        return best, score, score - second < AMBIGUOUS


def may_learn(doc_id):
    """crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _language_counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """lang to its numbers of n-grams, over all rows(text, lang); a task gives at most BUCKETS rows a language."""

    def counted(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            lang = b.column(1).dictionary_encode()
            code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
            for first, last, data, offsets in _groups(b.column(0)):
                own = code[first:last]
                sums = np.zeros(len(names) * BUCKETS, np.int64)
                for text, bucket in grams(data, offsets):
                    sums += np.bincount(own[text] * BUCKETS + bucket, minlength=len(sums))
                for i in np.unique(own):
                    total[names[i]] = total.get(names[i], 0) + sums[i * BUCKETS : (i + 1) * BUCKETS]
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "bucket", "n"])

    sums = rows.select("text", "lang").mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, np.ndarray] = {}
    lang = sums.column("lang").combine_chunks().dictionary_encode()
    code, bucket, n = lang.indices.to_numpy(), sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        out[name] = np.zeros(BUCKETS, np.int64)
        out[name][bucket[code == i]] = n[code == i]
    return out


def _hits(rows: DataFrame, model: Model) -> np.ndarray:
    """(languages, bits, 2): how often the classifier of a bit was right, and how often it was asked."""
    index, bits = {x: i for i, x in enumerate(model.languages)}, model.code.shape[1]
    held = rows.sparkSession.sparkContext.broadcast(model)

    def counted(batches):
        total = np.zeros((len(index), bits, 2), np.int64)
        for b in batches:
            own = np.array([index.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            for first, last, data, offsets in _groups(b.column(0)):
                who = own[first:last]
                right = held.value.margins(data, offsets) * held.value.code[who] > 0
                np.add.at(total[:, :, 0], who[who >= 0], right[who >= 0])
                np.add.at(total[:, :, 1], who[who >= 0], 1)
        who, bit = np.nonzero(total[:, :, 1])
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(bit), pa.array(total[who, bit, 0]), pa.array(total[who, bit, 1])], ["who", "bit", "hit", "n"])

    out = np.zeros((len(index), bits, 2), np.int64)
    sums = rows.select("text", "lang").mapInArrow(counted, "who long, bit long, hit long, n long").groupBy("who", "bit").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    for r in sums.collect():  # a row a language and bit
        out[r.who, r.bit] = r.hit, r.n
    return out


def train(docs: DataFrame, learnable=may_learn) -> Model:
    """A model of all rows(doc_id, text, lang) that may be learnt from."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    counts = _language_counts(rows)
    languages = sorted(counts)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    n = np.stack([counts[x] for x in languages]).astype(np.float64) + SMOOTHING
    share = n / n.sum(1, keepdims=True)
    one, none = (code > 0).astype(np.float64), (code < 0).astype(np.float64)
    weight = np.log(share.T @ one / one.sum(0)) - np.log(share.T @ none / none.sum(0))
    model = Model(languages, code, weight.astype(np.float32), np.ones(code.shape))
    if code.shape[1]:
        hits = _hits(rows, model)
        right = (hits[:, :, 0] + 1) / (hits[:, :, 1] + 2)
        model.trust = right / right.mean(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of rows(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def predicted(batches):
        own = held.value
        for b in batches:
            lettered = b.column(2).to_numpy(zero_copy_only=False)
            best, score, unsure = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if own.languages:
                for first, last, data, offsets in _groups(b.column(1)):
                    best[first:last], score[first:last], unsure[first:last] = own.decode(own.margins(data, offsets))
            known = lettered & bool(own.languages)
            names = [own.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(unsure | ~known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return inner.mapInArrow(predicted, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    held_out = F.coalesce(~may_learn(F.col("doc_id")), F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
