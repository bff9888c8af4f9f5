"""Nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of BOOKS codewords, one of each full-dimensional codebook.
Codebooks start as k-means of the residuals that earlier ones leave, on a bounded sample of
MAX_TRAIN vectors, and are then refined: encode by beam search, solve the least-squares problem
for all codewords together, and again. Encoding keeps the BEAM best partial sums per vector.

The index is a written table of one row per vector: codes (one byte each), squared norm of the
sum, and the original vector. A search takes queries in blocks of bounded size. Each task forms a
table of inner products of the queries with all codewords; the distance of a row is then the sum
of BOOKS looked-up numbers and the stored norm. The RERANK nearest rows of each chunk are measured
exactly, in double precision on the original vectors, and the best k of a task go on to the final
choice. A common vector is only ever a few rows per task.

Defined cases: vectors null, zero, or with null or non-finite components take no part, as do those
of another than the commonest dimension; equal scores rank by smaller vec_id; a candidate with the
query's own vec_id is left out; rows with a null vec_id are candidates, last among equals, and no queries; repeated rows are candidates each, and queries each; fewer
candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace

BOOKS = 8
WORDS = 256
BEAM = 4
MAX_TRAIN = 10_000
ROUNDS = 2
RERANK = 96
CHUNK = 2048
QUERY_BLOCK = 2048
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (0.5 * (book**2).sum(1) - x @ book.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Deterministic: starts from evenly spaced rows; an empty cell takes the row worst served."""
    book = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, book)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(n)
        book[filled] = np.add.reduceat(x[order], (np.cumsum(n) - n)[filled], axis=0) / n[filled, None]
        if len(filled) < k:
            worst = np.argsort(-((x - book[at]) ** 2).sum(1), kind="stable")
            empty = np.flatnonzero(n == 0)
            book[empty] = x[worst[np.arange(len(empty)) % len(x)]]
    return book


class Codebooks:
    """`books`: (M, K, d)."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.half = 0.5 * (self.books**2).sum(2)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, M) by beam search over the codebooks in order."""
        n, d = x.shape
        m, k, _ = self.books.shape
        rest, cost, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for i in range(m):
            # |r - c|^2 / 2 = |r|^2 / 2 - r.c + |c|^2 / 2
            gain = self.half[i] - rest @ self.books[i].T + cost[:, :, None]
            flat = gain.reshape(n, -1)
            keep = min(beam, flat.shape[1]) if i < m - 1 else 1
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // k, best % k
            cost = flat[rows, best]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[rows, parent] - self.books[i][word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[i][codes[:, i]] for i in range(len(self.books)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of all codewords with the queries: (M, K, queries)."""
        return np.einsum("mkd,qd->mkq", self.books, q.astype(np.float32), optimize=True)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> Codebooks:
    """x: unit vectors, at least one."""
    n, d = x.shape
    k = int(max(1, min(words, n // 4)))
    rest, start = x.astype(np.float64), []
    for _ in range(books):
        book = _kmeans(rest, k)
        rest = rest - book[_nearest(rest, book)]
        start.append(book)
    out = Codebooks(np.stack(start))
    best, error = out, ((x - out.decode(_encode_all(out, x))) ** 2).sum()
    for _ in range(rounds):
        codes = _encode_all(best, x)
        flat = codes.astype(np.int64) + np.arange(books) * k
        # Normal equations of the 0/1 matrix that picks the codewords of each vector.
        a = np.zeros((books * k, books * k))
        for i in range(books):
            for j in range(books):
                a[i * k : (i + 1) * k, j * k : (j + 1) * k] = np.bincount(codes[:, i].astype(np.int64) * k + codes[:, j], minlength=k * k).reshape(k, k)
        b = np.zeros((books * k, d))
        for i in range(books):
            np.add.at(b, flat[:, i], x)
        a[np.diag_indices(len(a))] += 0.05
        prior = 0.05 * best.books.reshape(-1, d)  # a codeword that nothing uses stays as it is
        tried = Codebooks(np.linalg.solve(a, b + prior).reshape(books, k, d))
        now = ((x - tried.decode(_encode_all(tried, x))) ** 2).sum()
        if now >= error:
            break
        best, error = tried, now
    return best


def _encode_all(books: Codebooks, x: np.ndarray) -> np.ndarray:
    return np.concatenate([books.encode(x[i : i + 1024]) for i in range(0, len(x), 1024)])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id long, v array<double>: the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), size.alias("_norm"), bad.alias("_bad"))
    return rows.filter("v IS NOT NULL AND NOT _bad AND _norm > 0 AND _norm < double('infinity')").select("vec_id", "v")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def build(vectors: DataFrame, work: Workspace) -> tuple[DataFrame, Codebooks] | None:
    """The index table (vec_id, v, codes, norm) and the codebooks; None if no vector takes part."""
    rows = valid(vectors)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not usual:
        return None
    rows = rows.filter(F.size("v") == usual[0].d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(MAX_TRAIN).toArrow()
    books = fit(_unit(_matrix(sample.column("v").combine_chunks())))

    def encoded(batches):
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                codes = books.encode(_unit(_matrix(part.column(1))))
                norm = (books.decode(codes) ** 2).sum(1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], ["vec_id", "v", "codes", "norm"])

    return work.write(rows.mapInArrow(encoded, "vec_id long, v array<double>, codes binary, norm float"), "index"), books


def _block(index: DataFrame, books: Codebooks, queries, k: int, rerank: int) -> DataFrame:
    """(q, query_id, vec_id, score): the best k of each task for each of a block's queries."""
    ids, matrix = np.array([r.vec_id if r.vec_id is not None else -1 for r in queries], np.int64), np.array([r.v for r in queries])
    held = index.sparkSession.sparkContext.broadcast((ids, matrix))  # at most some QUERY_BLOCK vectors

    def search(batches):
        ids, q = held.value
        nq = len(ids)
        unit, size = _unit(q), np.sqrt((q * q).sum(1))
        tables = books.tables(unit)
        best_s, best_id = np.full((nq, 0), -np.inf), np.zeros((nq, 0), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                vec = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                order = np.argsort(vec, kind="stable")
                vec, v = vec[order], _matrix(part.column(1))[order]
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)[order]
                near = -part.column(3).to_numpy()[order][:, None].astype(np.float64)
                near = np.repeat(near, nq, axis=1)
                for i in range(codes.shape[1]):
                    near += 2 * tables[i][codes[:, i]]
                near -= np.arange(len(vec))[:, None] * 1e-12  # equal codes: the smaller id first
                near[vec[:, None] == ids[None, :]] = -np.inf
                take = min(rerank, len(vec))
                top = np.argpartition(-near, take - 1, axis=0)[:take].T  # (queries, take)
                norms = np.sqrt((v * v).sum(1))
                exact = np.empty(top.shape)
                for j in range(0, nq, 256):
                    t = top[j : j + 256]
                    exact[j : j + 256] = (v[t] * q[j : j + 256, None, :]).sum(2) / (norms[t] * size[j : j + 256, None])
                exact[vec[top] == ids[:, None]] = -np.inf
                best_s, best_id = np.concatenate([best_s, exact], axis=1), np.concatenate([best_id, vec[top]], axis=1)
                pick = np.lexsort([best_id, -best_s], axis=1)[:, :k]
                best_s, best_id = np.take_along_axis(best_s, pick, 1), np.take_along_axis(best_id, pick, 1)
        row, col = np.nonzero(best_s > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(ids[row]), pa.array(best_id[row, col], mask=best_id[row, col] == NO_ID), pa.array(best_s[row, col])], ["q", "query_id", "vec_id", "score"])

    return index.mapInArrow(search, "q long, query_id long, vec_id long, score double")


RESULT = "query_id long, rank int, vec_id long, score double"


def neighbours(spark: SparkSession, vectors: DataFrame, is_query, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of every query row, nearest first."""
    work = Workspace(spark, "aq")
    built = build(vectors, work)
    if built is None:
        return spark.createDataFrame([], RESULT)
    index, books = built
    asked = index.filter(is_query(F.col("vec_id"))).select("vec_id", "v")
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    out = None
    for i in range(blocks):
        queries = numbered.filter(F.col("_block") == i).orderBy("vec_id", "v").collect()  # about QUERY_BLOCK rows
        if not queries:
            continue
        found = _block(index, books, queries, k, rerank).withColumn("_block", F.lit(i))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], RESULT)
    best = Window.partitionBy("_block", "q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
