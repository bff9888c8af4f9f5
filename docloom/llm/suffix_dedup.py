"""Removing long repeated passages with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else.

Sparse suffixes. Of the suffixes of a text only anchored ones are kept: in every window of
`length` bytes the K-byte string with the least hash, the leftmost of equals (winnowing). The
anchor of a window depends on the window's bytes alone, so two equal windows have anchors at
the same offset, and only suffixes whose beginnings agree for K bytes need comparing. For 400
bytes about one byte in 170 is an anchor.

Family of arrays. A suffix array holds the distinct anchored suffixes of some batches, ordered by
their first K bytes, as a table in ranges of that order with the length of the prefix that each
shares with its predecessor. A new batch is merge-scanned against the levels that are there: one
pass over the joint order compares neighbours, and a suffix is met again if it shares K bytes with
one before it. Levels no larger than what they meet merge in the same pass, so B equal batches leave
at most log2(B) + 1 levels and a suffix is rewritten as often. Levels are kept in the family's
folder: `SuffixFamily` on the same folder goes on where it stood. A corpus is dealt into about
1 + log4(suffixes / BATCH_SUFFIXES) batches, each three times all before it: every pass merges what is
there into one level, and all passes together order 4/3 of the suffixes, whatever their number.

Long matches. A suffix that was met agrees for K bytes only, so its windows are compared in full:
 1. the block, all bytes of all windows with this anchor: an equal block elsewhere means every
    window of it repeats;
 2. otherwise nodes of NODE neighbouring windows at fixed distances from the anchor: the bytes
    that all of them share must repeat, else none does; if the bytes of all together repeat, all do;
 3. otherwise each window of the node by itself.
Comparisons are by 128-bit digests, counted with partial sums, so that a passage in a third of
all documents is one row per task. Nothing pairs the copies, and no group is gathered anywhere.
Neighbours in suffix order alone would not be exact here: the neighbour that agrees longest to the
right of an anchor need not be the one that agrees longest to its left.

Defined cases: a null text has no bytes; rows equal in id and text are different documents;
texts under `length` bytes never match; an empty table gives an empty result; very long texts are
winnowed in parts with the same result; columns of any name go along. A removed run may cut
a character; `remove` then drops its rest from the text, while `digests` counts bytes exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Workspace, list_names, record_batches, release, remove_path

LENGTH = 400
K = 64
NODE = 48
BATCH_SUFFIXES = 1_000_000
_GROUP = 400_000  # bytes winnowed at once: the arrays stay in cache
_LONG = 1_000_000  # longer texts are winnowed in overlapping parts; a part takes some 60 bytes of memory a byte
_POS = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """(anchor, first window, last window) for every run of windows with one anchor; texts are data[start:end]."""
    n, width = len(data), length - K + 1  # K-byte strings in a window
    keep = ends - starts >= length
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros((3, 0), np.int64)
    h, power, m = _BYTE[data], _BASE, 1
    with np.errstate(over="ignore"):
        while m < K:
            h = h[:-m] * power + h[m:]
            power, m = power * power, 2 * m
        h = _mix(h)
    v = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= width:
        v = np.minimum(v[:-m], v[m:])
        m *= 2
    if m < width:
        v = np.minimum(v[: n - length + 1], v[width - m :])
    sizes = ends - starts - length + 1
    windows = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at = (v[windows] & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return np.stack([at[first], windows[first], windows[last]])


def suffixes(texts, length: int = LENGTH):
    """For groups of an iterable of texts: (text numbers, anchor / first / last window, first K bytes of the suffixes, block digests)."""
    digest = xxhash.xxh3_128_digest

    def described(joined: bytes, number, found, shift):
        at = found.T.tolist()
        return number, found - shift, [joined[a : a + K] for a, _, _ in at], [digest(joined[lo : hi + length]) for _, lo, hi in at]

    def winnowed(base: int, group: list[bytes]):
        joined = group[0] if len(group) == 1 else b"".join(group)
        if len(joined) > _LONG:  # one long text, in parts that overlap; a run of windows is whole in the part where it starts
            for at in range(0, len(joined) - length + 1, _LONG):
                left = max(0, at - 1)  # the window before tells whether the first run started earlier
                part = joined[left : at + _LONG + 2 * length - K]
                found = _anchors(np.frombuffer(part, np.uint8), np.zeros(1, np.int64), np.array([len(part)]), length)
                found = found[:, (found[1] >= at - left) & (found[1] < at - left + _LONG)]
                yield described(part, np.full(found.shape[1], base), found, -left)
        elif len(joined) >= length:
            ends = np.cumsum([len(t) for t in group])
            starts = np.concatenate([[0], ends[:-1]])
            found = _anchors(np.frombuffer(joined, np.uint8), starts, ends, length)
            number = np.searchsorted(ends, found[0], side="right")
            yield described(joined, number + base, found, starts[number])

    group: list[bytes] = []
    total = base = 0
    for i, text in enumerate(texts):
        if group and total + len(text or b"") > _GROUP:
            yield from winnowed(base, group)
            group, total, base = [], 0, i
        group.append(text or b"")
        total += len(group[-1])
    if group:
        yield from winnowed(base, group)


def _row_key():
    """128 bits that stand for a row: rows equal in id and text have equal results."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))))


def postings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per anchored suffix of docs(rk, body)."""

    def run(batches):
        for b in batches:
            for which, (a, lo, hi), keys, blocks in suffixes((x.as_py() for x in b.column(1)), length):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(a), pa.array(lo), pa.array(hi), pa.array(keys, pa.binary()), pa.array(blocks, pa.binary())], ["rk", "pos", "lo", "hi", "suffix", "block"])

    return docs.mapInArrow(run, "rk binary, pos long, lo long, hi long, suffix binary, block binary")


#: What a suffix of a merge scan is: of a level that stays, of a level that merges, of the new batch.
_STAYS, _MERGES, _FRESH = 0, 1, 2
_DRAWN = 40  # suffixes drawn for each range of the order


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of suffixes as rows of K bytes."""
    fixed = column.cast(pa.binary(K))
    return np.frombuffer(fixed.buffers()[1], np.uint8, len(fixed) * K, fixed.offset * K).reshape(-1, K) if len(fixed) else np.zeros((0, K), np.uint8)


def _column(text: np.ndarray) -> pa.Array:
    offsets = np.arange(len(text) + 1, dtype=np.int32) * np.int32(K)
    return pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))])


def _combined(bounds: np.ndarray):
    """(suffix, kind) to (suffix, kind, n, range): equal ones of a task are one row, so that no suffix fills a range of the order."""

    def counted(held):
        table = pa.Table.from_batches(held).group_by(["suffix", "kind"]).aggregate([("n", "sum")])
        for b in table.to_batches(max_chunksize=20_000):
            at = np.searchsorted(bounds, _matrix(b.column("suffix")).view(f"S{K}").ravel(), side="right")
            yield pa.RecordBatch.from_arrays([b.column("suffix"), b.column("kind"), b.column("n_sum"), pa.array(at.astype(np.int32))], ["suffix", "kind", "n", "range"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ones(b.num_rows, np.int64))], ["suffix", "kind", "n"]))
            size += b.num_rows
            if size > 100_000:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    return run


def _shared(text: np.ndarray) -> np.ndarray:
    """Of each of some ordered rows of K bytes the bytes that it shares with its predecessor; none for the first."""
    if not len(text):
        return np.zeros(0, np.int64)
    same = text[1:] == text[:-1]
    return np.concatenate([[0], np.where(same.all(1), K, same.argmin(1))])


def shared_prefixes(suffixes: list[bytes]) -> np.ndarray:
    """Of each of some ordered suffixes the bytes that it shares with its predecessor; none for the first."""
    return _shared(np.frombuffer(b"".join(suffixes), np.uint8).reshape(len(suffixes), K))


def _scanned(batches):
    """Ordered (suffix, kind, n) of a range to its array of those that do not stay in a level: (suffix, lcp, met)."""
    empty = np.zeros((0, K), np.uint8)
    text, kind, n = empty, np.zeros(0, np.int32), np.zeros(0, np.int64)  # the last suffix, which may go on in the next batch
    before = empty  # the last one given out

    def given(text, kind, n):
        nonlocal before
        keep = kind > _STAYS
        text = text[keep]
        lcps = _shared(np.concatenate([before, text]))[len(before) :]
        before = text[-1:] if len(text) else before
        return pa.RecordBatch.from_arrays([_column(text), pa.array(lcps.astype(np.int64)), pa.array((kind == _FRESH)[keep] & (n > 1)[keep])], ["suffix", "lcp", "met"])

    for b in batches:
        for lo in range(0, b.num_rows, 20_000):
            part = b.slice(lo, 20_000)
            text, kind, n = np.concatenate([text, _matrix(part.column(0))]), np.concatenate([kind, part.column(1)]), np.concatenate([n, part.column(2)])
            first = np.flatnonzero(np.concatenate([[True], _shared(text)[1:] < K]))
            text, kind, n = text[first], np.maximum.reduceat(kind, first), np.add.reduceat(n, first)
            yield given(text[:-1], kind[:-1], n[:-1])
            text, kind, n = text[-1:], kind[-1:], n[-1:]
    yield given(text, kind, n)


def drawn_bounds(rows: DataFrame, ranges: int) -> np.ndarray:
    """Where ranges of the order begin, by suffixes drawn from rows(suffix); a suffix drawn often counts once."""
    share = min(1.0, _DRAWN * ranges / max(1, rows.count()))
    drawn = np.array(sorted({bytes(x.suffix) for x in rows.select("suffix").sample(share, 1).collect()}), f"S{K}")
    return drawn[np.unique(np.arange(1, ranges) * len(drawn) // ranges)] if len(drawn) else drawn


class SuffixFamily:
    """Suffix arrays of batches in levels, tables of a folder that are found again; level-a-b holds batches a to b."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spans = sorted(tuple(map(int, x.split("-")[1:])) for x in list_names(spark, folder) if x.startswith("level-"))
        self.levels = [x for x in spans if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans)]  # a merge that was cut off leaves its parts behind
        for x in set(spans) - set(self.levels):
            remove_path(spark, self._path(x))

    def _path(self, level: tuple[int, int]) -> str:
        return f"{self.folder}/level-{level[0]}-{level[1]}"

    def array(self, level: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("suffix binary, lcp long, met boolean").parquet(self._path(level))

    def add(self, batch: DataFrame, units: int = 1, bounds: np.ndarray | None = None) -> DataFrame:
        """Take in a batch(suffix): its suffixes that it repeats, in itself or from earlier batches.

        Levels are as large as the units that they hold; a batch that is larger than others counts for more.
        Bounds of ranges that are known to be even need not be drawn.
        """
        first = self.levels[-1][1] + 1 if self.levels else 0
        stay, own, size = list(self.levels), (first, first + units - 1), units
        while stay and stay[-1][1] - stay[-1][0] < size:
            own = (stay.pop()[0], own[1])
            size = own[1] - own[0] + 1
        rows = batch.select("suffix", F.lit(_FRESH).alias("kind"))
        for level in self.levels:
            rows = rows.unionByName(self.array(level).select("suffix", F.lit(_STAYS if level in stay else _MERGES).alias("kind")))
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions")) if bounds is None else len(bounds) + 1
        bounds = drawn_bounds(rows, ranges) if bounds is None else bounds
        dealt = rows.mapInArrow(_combined(bounds), "suffix binary, kind int, n long, range int")
        ordered = dealt.repartitionById(ranges, F.col("range")).select("suffix", "kind", "n").sortWithinPartitions("suffix")
        made, met = f"{self.folder}/new-{own[0]}-{own[1]}", f"{self.folder}/met-{first}"
        ordered.mapInArrow(_scanned, "suffix binary, lcp long, met boolean").write.mode("overwrite").parquet(made)
        self.spark.read.schema("suffix binary, met boolean").parquet(made).filter("met").select("suffix").write.mode("overwrite").parquet(met)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path(made).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(path(made), path(self._path(own)))
        for x in self.levels[len(stay) :]:
            remove_path(self.spark, self._path(x))
        self.levels = [*stay, own]
        return self.spark.read.schema("suffix binary").parquet(met)


def _nodes(length: int):
    """(first, last) distance from the anchor back to a window's start, for every node."""
    width = length - K + 1
    return [(d, min(d + NODE, width) - 1) for d in range(0, width, NODE)]


def _contexts(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The bytes around each representative suffix, as far as its windows may reach."""
    wanted = reps.groupBy("rk").agg(F.collect_list(F.struct("pos", "lo", "hi", "n")).alias("spots"))
    joined = docs.join(wanted.hint("shuffle_hash"), "rk").select("rk", "body", "spots")  # texts are not sorted for it

    def spots(batches):
        seen = set()
        for b in batches:
            for rk, body, spots in zip(*b.columns):
                rk, body = rk.as_py(), body.as_py()
                if rk in seen:  # rows equal in id and text have one key; their blocks count them all, so one will do
                    continue
                seen.add(rk)
                for s in spots.as_py():
                    left = max(0, s["pos"] - length + K)
                    yield rk, s["pos"], s["n"], s["pos"] - s["hi"], s["pos"] - s["lo"], s["pos"] - left, body[left : s["pos"] + length]

    def run(batches):
        yield from record_batches(spots(batches), _CONTEXT_NAMES, _CONTEXT_TYPES)

    return joined.mapInArrow(run, "rk binary, pos long, n long, near long, far long, at long, ctx binary")


_CONTEXT_NAMES = ["rk", "pos", "n", "near", "far", "at", "ctx"]
_CONTEXT_TYPES = [pa.binary(), *[pa.int64()] * 5, pa.binary()]


def _node_rows(contexts: DataFrame, length: int) -> DataFrame:
    def nodes(batches):
        digest, nodes_of = xxhash.xxh3_128_digest, _nodes(length)
        for b in batches:
            for rk, pos, n, near, far, at, ctx in zip(*(c.to_pylist() for c in b.columns)):
                for j, (d1, d2) in enumerate(nodes_of):
                    if d2 < near or d1 > far or d1 > at or at - d2 + length > len(ctx):
                        continue
                    whole = digest(ctx[at - d2 : at - d1 + length]) if d2 <= at and at - d1 + length <= len(ctx) else None
                    yield rk, pos, n, j, digest(ctx[at - d1 : at - d2 + length]), whole

    def run(batches):
        yield from record_batches(nodes(batches), ["rk", "pos", "n", "node", "core", "whole"], [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    return contexts.mapInArrow(run, "rk binary, pos long, n long, node int, core binary, whole binary")


def _window_rows(contexts: DataFrame, live: DataFrame, length: int) -> DataFrame:
    lists = live.groupBy("rk", "pos").agg(F.collect_set("node").alias("nodes"))
    joined = contexts.join(lists, ["rk", "pos"]).select(*_CONTEXT_NAMES, "nodes")

    def windows(batches):
        digest, nodes = xxhash.xxh3_128_digest, _nodes(length)
        for b in batches:
            for rk, pos, n, near, far, at, ctx, js in zip(*(c.to_pylist() for c in b.columns)):
                for j in js:
                    for d in range(max(near, nodes[j][0]), min(far, nodes[j][1]) + 1):
                        if d <= at and at - d + length <= len(ctx):
                            yield rk, n, pos - d, digest(ctx[at - d : at - d + length])

    def run(batches):
        yield from record_batches(windows(batches), ["rk", "n", "start", "string"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()])

    return joined.mapInArrow(run, "rk binary, n long, start long, string binary")


def batch_ends(suffixes: int, batch: int) -> list[int]:
    """Of the units that a corpus is dealt into those where its batches end: one, then three times all before."""
    ends = [1]
    while ends[-1] * batch < suffixes:
        ends.append(4 * ends[-1])
    return ends


def repeated_ranges(spark: SparkSession, docs: DataFrame, work: Workspace, length: int = LENGTH, batch_suffixes: int | None = None) -> DataFrame:
    """(rk, spans): byte ranges to remove for each row of docs(rk, body) that has any."""
    every = work.write(postings(docs, length), "postings")
    ends = batch_ends(every.count(), batch_suffixes or BATCH_SUFFIXES)
    family = SuffixFamily(spark, f"{work.path}/family")
    bounds = drawn_bounds(every, int(spark.conf.get("spark.sql.shuffle.partitions")))  # batches are dealt at random, so all have one order
    met = None
    for lo, hi in zip([0, *ends], ends):
        dealt = F.pmod(F.xxhash64("rk"), F.lit(ends[-1]))
        own = family.add(every.filter((dealt >= lo) & (dealt < hi)).select("suffix"), hi - lo, bounds)
        met = own if met is None else met.unionByName(own)
        release(spark)
    # a key may stand for two suffixes: then more is found, and what is found is compared in full
    shared = work.write(met.select(F.xxhash64("suffix").alias("key")).distinct(), "shared")
    found = work.write(every.withColumn("key", F.xxhash64("suffix")).drop("suffix").join(shared, "key", "left_semi"), "found")
    work.drop("family")
    work.drop("postings")
    release(spark)

    least = F.min(F.struct("rk", "pos", "lo", "hi")).alias("rep")  # a block holds its suffix
    reps = work.write(found.groupBy("block").agg(F.count("*").alias("n"), least, F.first("key").alias("key")).select("key", "block", "n", "rep.*"), "reps")
    twice = reps.filter("n > 1").select("block")
    ranges = work.write(found.join(twice, "block", "left_semi").select("rk", "lo", (F.col("hi") + length).alias("hi")), "ranges-0")
    open_keys = work.write(reps.filter("n = 1").select("key").distinct(), "open")
    contexts = work.write(_contexts(docs, reps.join(open_keys, "key", "left_semi"), length), "contexts")
    release(spark)

    rows = work.write(_node_rows(contexts, length), "nodes")
    cores = work.write(rows.groupBy("core").agg(F.sum("n").alias("n"), F.min("n").alias("least")).filter("n > 1 AND least = 1").select("core"), "cores")
    wholes = work.write(rows.filter("whole IS NOT NULL").groupBy("whole").agg(F.sum("n").alias("w")).filter("w > 1").select("whole"), "wholes")
    bounds = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _nodes(length)]), F.col("node") + 1)
    in_whole = rows.filter("n = 1").join(wholes, "whole", "left_semi")
    ranges1 = work.write(in_whole.select("rk", (F.col("pos") - bounds["b"]).alias("lo"), (F.col("pos") - bounds["a"] + length).alias("hi")), "ranges-1")
    single = work.write(rows.filter("n = 1").join(wholes, "whole", "left_anti").select("core").distinct(), "single")
    unsettled = work.write(cores.join(single, "core", "left_semi"), "unsettled")
    live = rows.join(unsettled, "core", "left_semi").select("rk", "pos", "node")
    windows = work.write(_window_rows(contexts, live, length), "windows")
    strings = work.write(windows.groupBy("string").agg(F.sum("n").alias("w")).filter("w > 1").select("string"), "strings")
    ranges2 = windows.filter("n = 1").join(strings, "string", "left_semi").select("rk", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))
    out = ranges.unionByName(ranges1).unionByName(ranges2).groupBy("rk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    out = work.write(out, "spans")
    for name in ("found", "contexts", "nodes", "windows"):
        work.drop(name)
    release(spark)
    return out


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def cut(body: bytes, spans, min_words: int = 0) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, removed runs); runs of fewer than `min_words` words stay."""
    runs = merge_spans((s["lo"], s["hi"]) for s in spans or ())
    runs = [(lo, hi) for lo, hi in runs if not min_words or len(body[lo:hi].split()) >= min_words]
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(body[at:lo])
        at = hi
    kept.append(body[at:])
    return b"".join(kept), sum(hi - lo for lo, hi in runs), len(runs)


def _with_spans(spark: SparkSession, docs: DataFrame, columns: list[str], length: int) -> DataFrame:
    work = Workspace(spark, "suffix")
    rows = docs.select(F.struct(*columns).alias("row"), _row_key().alias("rk"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    spans = repeated_ranges(spark, rows.select("rk", "body"), work, length)
    return rows.join(spans.hint("shuffle_hash"), "rk", "left").select("row", "body", "spans")


def digests(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""

    def rows(batches):
        for b in batches:
            for doc_id, body, spans in zip(*b.columns):
                body = body.as_py()
                kept, removed, runs = cut(body, spans.as_py())
                yield doc_id.as_py(), len(body), removed, runs, hashlib.sha256(kept).hexdigest()

    def run(batches):
        yield from record_batches(rows(batches), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [*[pa.int64()] * 4, pa.string()])

    return _with_spans(spark, docs, ["doc_id"], length).select(F.col("row.doc_id").cast("long").alias("doc_id"), "body", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(spark: SparkSession, docs: DataFrame, length: int = LENGTH, min_words: int = 0) -> DataFrame:
    """The documents without their repeated passages; a column n_chars, if there, follows the text.

    With `min_words` only runs of that many words go: set `length` to bytes that so many words always have.
    """
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([f if i != at else T.StructField("text", T.StringType()) for i, f in enumerate(docs.schema.fields)])

    def run(batches):
        for b in batches:
            bodies, spans = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            there = b.column(at).to_pylist()
            texts = [cut(body, s, min_words)[0].decode("utf-8", "ignore") if ok else None for ok, body, s in zip(there, bodies, spans)]
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names)))], names)

    rows = _with_spans(spark, docs, names, length)
    flagged = rows.select(*[F.col("row.text").isNotNull().alias("_c") if c == "text" else F.col("row")[c].alias(f"_c{i}") for i, c in enumerate(names)], "body", "spans")
    out = flagged.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
