"""Compression of vectors to short codes by codebooks of their parts.

Components become whole numbers, so that every sum and distance is exact and results do not depend on the order of rows.
A vector is cut into PARTS equal consecutive parts, and each part position has a codebook of ENTRIES entries. Codebooks
start as the parts of the first vectors by id; a round assigns every part to its nearest entry and moves each entry to the
componentwise mean, rounded down, of what it got.

For a round the driver builds one kd-tree for each codebook, and the trees go to the tasks (PARTS * ENTRIES points). The
search is by branch and bound: a batch of parts goes down together, each to the child whose box is nearer, and
comes back to the other child where that box is no farther than the best distance so far. Boxes at an equal distance
are visited too, so that of entries at the same distance the lower index is found. A task sums what it assigned
to each entry; Spark adds these sums, and the driver gets one row an entry.

The error of a label is summed over all its rows. Labels with more rows than a partition's share are fewer than partitions,
so their sums are broadcast; the others are joined by shuffle, where no key is large.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those of another length than
the commonest (of equally common ones the shorter); a length that is no positive multiple of PARTS is filled up with zeros;
a null id comes last and keeps its row; repeated rows count each and have equal codes; fewer vectors than
ENTRIES make smaller codebooks; null labels are one label; an empty table gives an empty result. Other columns are
not read. Components of 2^20 and more in absolute value are refused, as squared distances must fit 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 4
BATCH = 8192
LARGEST = 2.0**20


@dataclass
class Tree:
    """A kd-tree over the entries of one codebook: boxes of the nodes, children (-1 at a leaf), entries of each leaf."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: list[int]
    right: list[int]
    leaf: list[np.ndarray]

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        low, high, left, right, leaf = [], [], [], [], []

        def add(rows: np.ndarray) -> int:
            at = len(left)
            inside = points[rows]
            low.append(inside.min(0))
            high.append(inside.max(0))
            left.append(-1)
            right.append(-1)
            leaf.append(np.sort(rows))
            if len(rows) > LEAF:
                order = rows[np.argsort(inside[:, np.argmax(high[at] - low[at])], kind="stable")]
                left[at], right[at] = add(order[: len(rows) // 2]), add(order[len(rows) // 2 :])
            return at

        add(np.arange(len(points)))
        return cls(points, np.array(low), np.array(high), left, right, leaf)

    def bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """Least squared distance of rows to a node's box."""
        off = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return (off * off).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; of equally near ones the lower index."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        at = np.full(len(x), len(self.points))

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            own = x[rows]
            if self.left[node] < 0:
                for entry in self.leaf[node]:
                    off = own - self.points[entry]
                    d = (off * off).sum(1)
                    won = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
                    best[rows[won]], at[rows[won]] = d[won], entry
                return
            a, b = self.left[node], self.right[node]
            to_a, to_b = self.bound(a, own), self.bound(b, own)
            first = to_a <= to_b
            visit(a, rows[first])
            visit(b, rows[~first])
            visit(b, rows[first & (to_b <= best[rows])])
            visit(a, rows[~first & (to_a <= best[rows])])

        visit(0, np.arange(len(x)))
        return at, best


class Codebooks:
    """`entries`: (PARTS, entries, width) whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees = [Tree.build(e) for e in entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: (rows, PARTS, width) to codes and squared distances, (rows, PARTS) each."""
        found = [t.nearest(x[:, i]) for i, t in enumerate(self.trees)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.entries[i][codes[:, i]] for i in range(len(self.entries))], 1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole(vectors: pa.Array, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """(rows, parts, width) whole numbers of an Arrow array of lists of equal length."""
    n = len(vectors)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    if (np.abs(x) >= LARGEST).any():
        raise ValueError(f"components of {LARGEST:g} and more are not supported")
    width = max(1, -(-x.shape[1] // parts))
    out = np.zeros((n, parts * width), np.int64)
    out[:, : x.shape[1]] = np.floor(scale * x)
    return out.reshape(n, parts, width)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, v, label of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v"), "label").filter(F.col("v").isNotNull() & ~bad)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == usual[0].d if usual else F.lit(False))


def _batches(batches, column: int, books: Codebooks):
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            part = b.slice(lo, BATCH)
            x = whole(part.column(column), len(books.entries))
            yield part, x, *books.assign(x)


def improve(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries move to the means of what is nearest to them; a task gives one row an entry at most."""
    parts, entries, width = books.entries.shape

    def summed(batches):
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, x, code, _ in _batches(batches, 0, books):
            at = (code + np.arange(parts) * entries).reshape(-1)
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            total[used] += np.add.reduceat(x.reshape(-1, width)[order], first, axis=0)
            n += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["entry", "n", "total"])

    sums = rows.select("v").mapInArrow(summed, "entry long, n long, total array<long>").groupBy("entry")
    out = books.entries.reshape(parts * entries, width).copy()
    for r in sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).collect():  # a row an entry
        out[r.entry] = np.array(r.total, np.int64) // r.n
    return Codebooks(out.reshape(books.entries.shape))


def fit(rows: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of all rows(vec_id, v); None without rows."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).toArrow()
    if not first.num_rows:
        return None
    books = Codebooks(np.ascontiguousarray(whole(first.column("v").combine_chunks(), parts).swapaxes(0, 1)))
    for _ in range(rounds):
        books = improve(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of rows(vec_id, v, label)."""
    digits = np.array([[ord(c) for c in f"{i:02x}"] for i in range(books.entries.shape[1])], np.uint8)

    def coded(batches):
        for part, _, code, far in _batches(batches, 2, books):
            text = digits[code].reshape(len(code), -1)
            codes = [row.tobytes().decode() for row in text]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    inner = rows.select("vec_id", "label", "v")
    kind = {c: inner.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return inner.mapInArrow(coded, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def label_errors(rows: DataFrame, work: Workspace) -> DataFrame:
    """rows(label, error, ..) with label_error, the sum over the rows of an equal label."""
    totals = work.write(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    share = totals.agg(F.sum("_n")).first()[0] or 0
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = F.col("_n") * most > share  # fewer labels than partitions
    totals = totals.withColumnRenamed("label", "_label")
    found = rows.join(F.broadcast(totals.filter(large)), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    rest = found.filter("_n IS NULL").drop("label_error", "_n").join(totals.filter(~large), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return found.filter("_n IS NOT NULL").drop("_n").unionByName(rest.drop("_n"))


def compress(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    work = Workspace(spark, "codes")
    rows = kept(vectors)
    books = fit(rows)
    if books is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = label_errors(work.write(encode(rows, books), "codes"), work)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN first USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT vec_id, label, parts.p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN b{i} ON parts.p = b{i}.p)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{i} GROUP BY 1, 2)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY k) AS c FROM (SELECT p, e, k, CAST(sum(x[k]) AS DOUBLE) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS k FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    steps.append(f"o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"


ORACLE_SQL = _oracle()
