"""Near-duplicate documents by Order MinHash and banded alignment.

Sketch. A text is its lower-case words. Its shingles are runs of five words, each labelled with
how often it came before (a repeated shingle counts as often as it stands). For each of `TABLES`
hash functions the `SIZE` least labelled shingles are taken and put back in text order; their
sequence is one bucket key. Two texts share a key if they share these shingles and their order,
so a key speaks for edit similarity and not for a bag of shingles.

Candidates. Texts with equal words are one class from the start. In the first FIRST tables every
text is compared with its bucket's least one: one pair per member, which settles nearly all
classes. Then buckets of all tables that hold several classes are looked at: in each round one text of
each class meets one of a leading class, all drawn anew by a hash of the round, until a round joins
few. Buckets that then still hold several classes are compared in full, by blocks of BLOCK members
against blocks: every pair of different classes is settled by its length, its word counts or the
bounds below, or aligned. So every pair of different classes that shares a bucket is
settled, and links inside a class that is known already are not looked for. The work of a large
bucket of distinct documents grows with the square of its members, divided by BLOCK in rows.

Verification. Texts are linked if at most a fifth of the longer one's words is edited: similarity
0.8 or more. Each word becomes one character (16 bits of its hash). First two bounds are taken from
runs of three words: as an edit spoils three of them, too few common ones mean that a pair is not
near; and the alignment at their common unique ones inside the band of the limit gives edits that
suffice. For the rest the alignment table is computed by bit strings inside a block, or by Spark's
`levenshtein` with a limit inside bands of growing width.
Classes are the connected components of the links; an id's class is its least doc_id.

Recall. Copies whose shingles agree in share J meet in a bucket with probability
1 - (1 - J^3)^36: all but 1 in 10^11 at J = 0.8, 0.9998 at 0.6, 0.992 at 0.5.

Defined cases: a text without words (null, empty, only symbols) is alone, whatever the others;
under five words the whole text is its only shingle; rows equal in text share a class; a null
doc_id takes part, and a class of only null ids has the class null; an empty table gives an empty
result; texts of any length are used whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, release
from docloom.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TABLES = 36
SIZE = 3
FIRST = 6
BLOCK = 128
ALIGNED = 4_000  # words up to which a block aligns its pairs itself
ROUNDS, WORTH = 4, 50  # rounds go on while a pair in so many joins classes; what they leave is compared in full
_BINS = 256  # word counts that a pair is sifted by
_WORD = re.compile(r"\w+")
_STEP = 65_536  # shingles hashed at once for one text


def _seeds(n: int) -> np.ndarray:
    out, x = [], 0x1234_5678_9ABC_DEF1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x | 1)
    return np.array(out, np.uint64)


_XOR, _MUL = _seeds(2 * TABLES)[::2, None], _seeds(2 * TABLES)[1::2, None]
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash, kept for words met before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _labelled(w: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence numbers, in text order."""
    k = min(WORDS, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * _P + w[i : i + len(h)]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if same.any():
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
        times = np.empty(len(s), np.uint64)
        times[order] = (np.arange(len(s)) - first).astype(np.uint64)
        h = np.where(times > 0, _mix(h + times * _P), h)
    return h


def sketch(w: np.ndarray) -> np.ndarray:
    """TABLES bucket keys of a text given as word hashes."""
    with np.errstate(over="ignore"):
        h = _labelled(w)
        best = np.zeros((TABLES, 0), np.int64)
        for at in range(0, len(h), _STEP):
            spots = np.concatenate([best, np.broadcast_to(np.arange(at, min(at + _STEP, len(h))), (TABLES, min(_STEP, len(h) - at)))], axis=1) if at else np.broadcast_to(np.arange(min(_STEP, len(h))), (TABLES, min(_STEP, len(h))))
            v = _mix((h[spots] ^ _XOR) * _MUL) if at else _mix((h[None, : spots.shape[1]] ^ _XOR) * _MUL)
            take = min(SIZE, v.shape[1])
            best = np.take_along_axis(spots, np.argpartition(v, take - 1, axis=1)[:, :take], axis=1)
        best.sort(axis=1)
        keys = np.arange(TABLES, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for i in range(best.shape[1]):
            keys = _mix(keys * _P + h[best[:, i]])
    return keys.view(np.int64)


SKETCH = "doc_id long, mark long, digest binary, n long, code binary, keys array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the raw text), digest of the words, number of words, words as characters, bucket keys; wordless texts have null digests."""

    def run(batches):
        hashes, pack = _Hashes(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                out = []
                for text in part.column(2):
                    words = _WORD.findall((text.as_py() or "").lower())
                    if not words:
                        out.append((None, 0, b"", []))
                        continue
                    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    code = (w >> np.uint64(48)).astype(np.uint16).tobytes()
                    out.append((xxhash.xxh3_128_digest(w.tobytes()), len(words), pack.compress(code), sketch(w)))
                digest, n, code, keys = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "digest", "n", "code", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, SKETCH)


def _near_in_length(n, m):
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _verified(work: Workspace, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs(a, b) within the limit of edits. `texts` is dealt out by digest, so only pairs move to it.

    Least texts of buckets stand in many pairs as `a`: their codes are fetched once each and joined as a plain table,
    whose hot keys Spark can split.
    """
    pairs = work.write(pairs, f"pairs-{name}")
    code = texts.select(F.col("digest").alias("_d"), "code")
    left = pairs.select("a").distinct().join(code, F.col("a") == F.col("_d")).select("a", F.col("code").alias("x"))
    left = work.write(left, f"left-{name}")
    right = work.write(pairs.join(code, F.col("b") == F.col("_d")).select("a", "b", F.col("code").alias("y")), f"right-{name}")
    joined = right.join(left, "a").select("a", "b", "x", "y").mapInArrow(_bounded, "a binary, b binary, x string, y string")
    joined = work.write(joined, f"bounded-{name}")
    limit = "CAST(floor((1 - 0.8BD) * greatest(length(x), length(y))) AS INT)"
    near = " OR ".join(f"levenshtein(x, y, {band}) >= 0" for band in (f"least(32, {limit})", f"least(256, {limit})", limit))
    work.write(joined.filter("x IS NULL").select("a", "b").unionByName(joined.filter("x IS NOT NULL").filter(near).select("a", "b")), f"links-{name}")
    for part in ("bounded", "left", "right"):
        work.drop(f"{part}-{name}")
    return work.read(f"links-{name}")


def _limit(n: int, m: int) -> int:
    return max(n, m) // 5


def _runs(w: np.ndarray):
    """The different runs of three words: their hashes in order, first places, times."""
    h = (w[:-2].astype(np.uint64) << np.uint64(42)) ^ (w[1:-1].astype(np.uint64) << np.uint64(21)) ^ w[2:].astype(np.uint64)
    return np.unique(h, return_index=True, return_counts=True)


def edit_bounds(a: np.ndarray, b: np.ndarray, runs_a=None, runs_b=None) -> tuple[int, int]:
    """(least, most) edits from a to b: an edit spoils three runs of three words at most; an alignment at common unique runs suffices."""
    n, m, limit = len(a), len(b), _limit(len(a), len(b))
    if min(n, m) < 3:
        most = max(n, m) if n != m or (a != b).any() else 0
        return min(most, abs(n - m)), most
    (ha, first_a, times_a), (hb, first_b, times_b) = runs_a or _runs(a), runs_b or _runs(b)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    least = max(abs(n - m), -((int(np.minimum(times_a[i], times_b[j]).sum()) - max(n, m) + 2) // 3))
    if least > limit:
        return least, max(n, m)
    once = (times_a[i] == 1) & (times_b[j] == 1)
    p, q = first_a[i[once]], first_b[j[once]]
    inside = np.abs(p - q) <= limit
    p, q = p[inside], q[inside]
    order = np.argsort(p)
    p, q = p[order], q[order]
    if not len(p):
        return least, max(n, m)
    rising = q > np.concatenate([[-1], np.maximum.accumulate(q)[:-1]])
    p, q = p[rising], q[rising]
    dp, dq = np.diff(p), np.diff(q)
    same = np.minimum(3, np.minimum(dp, dq))
    return least, int(max(p[0], q[0]) + np.maximum(dp - same, dq - same).sum() + max(n - p[-1] - 3, m - q[-1] - 3))


def _bounded(batches):
    """(a, b, packed codes of both) to (a, b, x, y): the words as characters where bounds do not settle the pair; pairs that are not near go."""
    unpack, seen, v, runs = zstandard.ZstdDecompressor(), None, None, None
    text = lambda w: (w + np.uint32(0x10000)).tobytes().decode("utf-32-le")
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            x, y, keep = [], [], []
            for first, p, q in zip(part.column(0), part.column(2), part.column(3)):
                if first.as_py() != seen:  # pairs of one text often come one after the other
                    seen, v = first.as_py(), np.frombuffer(unpack.decompress(p.as_py()), np.uint16).astype(np.uint32)
                    runs = _runs(v) if len(v) >= 3 else None
                w = np.frombuffer(unpack.decompress(q.as_py()), np.uint16).astype(np.uint32)
                least, most = edit_bounds(v, w, runs)
                keep.append(least <= _limit(len(v), len(w)))
                sure = not keep[-1] or most <= _limit(len(v), len(w))
                x.append(None if sure else text(v))
                y.append(None if sure else text(w))
            out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.string()), pa.array(y, pa.string())], ["a", "b", "x", "y"])
            yield out.filter(pa.array(keep, pa.bool_()))


def _star(work: Workspace, members: DataFrame, name: str) -> DataFrame:
    """Pairs of each member of another class with its bucket's least text."""
    leaders = members.groupBy("bucket").agg(F.min(F.struct("digest", "n", "root")).alias("leader"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    leaders = work.write(leaders.filter("_a < _b").select("bucket", "leader"), f"leaders-{name}")
    joined = members.join(leaders, "bucket").filter((F.col("root") != F.col("leader.root")) & _near_in_length(F.col("n"), F.col("leader.n")))
    return joined.select(F.col("leader.digest").alias("a"), F.col("digest").alias("b")).distinct()


def _drawn(members: DataFrame, i: int) -> DataFrame:
    """members(bucket, digest, n, root) to one text for each class of a bucket, drawn by a hash of round i."""
    draw = F.min(F.struct(F.xxhash64("digest", F.lit(i)).alias("lot"), "digest", "n")).alias("drawn")
    return members.groupBy("bucket", "root").agg(draw).select("bucket", "root", "drawn")


def _settle_classes(work: Workspace, members: DataFrame, roots: DataFrame, texts: DataFrame, known: list[str]) -> DataFrame:
    """`roots` after rounds in which drawn texts of a bucket's classes meet; `known` names the tables of tried pairs."""
    for i in range(ROUNDS):
        drawn = work.write(_drawn(_rooted(members.drop("root"), roots), i), f"drawn-{i}")
        leaders = drawn.groupBy("bucket").agg(F.min(F.struct("drawn", "root")).alias("first"), F.count("*").alias("_k")).filter("_k > 1")
        leaders = work.write(leaders.select("bucket", "first.root", F.col("first.drawn.digest").alias("d"), F.col("first.drawn.n").alias("m")), f"leaders-{i}")
        met = drawn.join(leaders.select("bucket", F.col("root").alias("_r"), "d", "m"), "bucket").filter((F.col("root") != F.col("_r")) & _near_in_length(F.col("drawn.n"), F.col("m")))
        pairs = met.select(F.least("d", "drawn.digest").alias("a"), F.greatest("d", "drawn.digest").alias("b")).distinct()
        found = _verified(work, pairs.join(_tried(work, known), ["a", "b"], "left_anti"), texts, f"round-{i}")
        known.append(f"pairs-round-{i}")
        roots = _joined(work, roots, found, f"round-{i}")
        if found.count() * WORTH < work.read(f"pairs-round-{i}").count():
            break
    return roots


def _tried(work: Workspace, known: list[str]) -> DataFrame:
    out = work.read(known[0])
    for name in known[1:]:
        out = out.unionByName(work.read(name))
    return out.select("a", "b")


def _counts(code: np.ndarray) -> np.ndarray:
    """How often the words of each of _BINS kinds occur, 255 at most."""
    return np.minimum(np.bincount(code % _BINS, minlength=_BINS), 255).astype(np.int16)


def sift(left, right, table: int):
    """(i, j) of the near-able pairs of left x right, each (roots, numbers of words, counts, keys), that share no table before this one.

    An edit changes two counts by one at most.
    """
    (ra, na, ca, ka), (rb, nb, cb, kb) = left, right
    for i in range(len(ra)):
        longer = np.maximum(na[i], nb)
        j = np.flatnonzero((rb != ra[i]) & (5 * np.minimum(na[i], nb) >= 4 * longer))
        j = j[~(kb[j, :table] == ka[i, :table]).any(axis=1)]
        if len(j):
            apart = np.abs(cb[j] - ca[i]).sum(axis=1, dtype=np.int64)
            yield from ((i, k) for k in j[apart <= 2 * (longer[j] // 5)].tolist())


def _places(w: np.ndarray) -> dict[int, int]:
    """Of each word the places where it stands, as bits."""
    out: dict[int, int] = {}
    for i, x in enumerate(w.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


def aligned(places: dict[int, int], n: int, w: np.ndarray, limit: int) -> bool:
    """Whether `limit` edits turn a text of n words at these places into w: a column of the alignment table is two bit strings."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, edits, left = full, 0, n, len(w)
    for x in w.tolist():
        same = places.get(x, 0)
        across = (((same & up) + up) ^ up) | same
        more = down | (full ^ ((across | up) & full))
        less = up & across
        edits += 1 if more & last else -1 if less & last else 0
        more = more << 1 | 1
        same |= down
        up = ((less << 1) | (full ^ ((same | more) & full))) & full
        down = more & same & full
        left -= 1
        if edits - left > limit:
            return False
    return edits <= limit


def _blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members(bucket, digest, n, root) of different classes that are near, or longer than ALIGNED words and left open by bounds.

    All pairs of a bucket are looked at, by blocks of BLOCK members against blocks, each pair in the first table that it
    shares (if the classes differ, its bucket there is among these too). Classes that a pair of a block has joined are one
    from then on, so a block gives a link for each class at most.
    """
    wanted = members.select(F.col("digest").alias("_w")).distinct()
    code = texts.select(F.col("digest").alias("_d"), "code", "keys").join(wanted, F.col("_d") == F.col("_w"), "left_semi")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = _sized(members).withColumn("own", F.pmod(F.xxhash64("digest"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.join(code, F.col("digest") == F.col("_d")).select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "digest", "n", "root", "code", "keys")

    def pairs(group: pa.Table) -> pa.Table:
        own, digest, root = (np.array(group.column(c).to_pylist(), object) for c in ("own", "digest", "root"))
        n, unpack = group.column("n").to_numpy(), zstandard.ZstdDecompressor()
        words = [np.frombuffer(unpack.decompress(c), np.uint16).astype(np.uint32) for c in group.column("code").to_pylist()]
        counts = np.stack([_counts(w) for w in words])
        keys = np.array(group.column("keys").to_pylist(), np.int64)
        here = int((keys[0] == group.column("bucket")[0].as_py()).argmax())
        first, same = group.column("p")[0].as_py(), group.column("p")[0].as_py() == group.column("q")[0].as_py()
        at = np.flatnonzero(own == first)
        to = at if same else np.flatnonzero(own != first)
        runs: dict[int, tuple] = {}
        places: dict[int, dict[int, int]] = {}
        parent: dict[bytes, bytes] = {}

        def top(r: bytes) -> bytes:
            while r in parent:
                r = parent[r]
            return r

        def of(held: dict, k: int, make):
            if k not in held and n[k] >= 3:
                held[k] = make(words[k])
            return held.get(k)

        a, b = [], []
        for i, j in sift((root[at], n[at], counts[at], keys[at]), (root[to], n[to], counts[to], keys[to]), here):
            i, j = int(at[i]), int(to[j])
            if (same and digest[i] >= digest[j]) or top(root[i]) == top(root[j]):
                continue
            limit = _limit(n[i], n[j])
            least, most = edit_bounds(words[i], words[j], of(runs, i, _runs), of(runs, j, _runs))
            near = least <= limit and most <= limit
            left_open = least <= limit and not near and max(n[i], n[j]) > ALIGNED
            if least <= limit and not near and not left_open:
                near = aligned(of(places, i, _places) or _places(words[i]), int(n[i]), words[j], limit)
            if near or left_open:
                a.append(min(digest[i], digest[j]))
                b.append(max(digest[i], digest[j]))
            if near:
                parent[top(root[i])] = top(root[j])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.groupBy("bucket", "p", "q").applyInArrow(pairs, "a binary, b binary")


def _joined(work: Workspace, roots: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """`roots` after the new links `found`, which join whole classes: components of the classes, then of their members."""
    lifted = found.join(roots.withColumnRenamed("root", "ra"), F.col("a") == F.col("node"), "left").drop("node").join(roots.withColumnRenamed("root", "rb"), F.col("b") == F.col("node"), "left")
    merged = components(work, lifted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), f"roots-{name}")
    return work.write(_lifted(roots, merged), f"all-{name}")


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows(.., digest) with the class that each text belongs to so far."""
    if roots is None:
        return rows.withColumn("root", F.col("digest"))
    return rows.join(roots.withColumnRenamed("root", "_r"), F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("_r", "digest")).drop("_r", "node")


def _mixed(members: DataFrame) -> DataFrame:
    """(bucket): those that hold more than one class. Classes are told apart by 64 bits inside a bucket."""
    mark = F.xxhash64("root")
    return members.groupBy("bucket").agg(F.min(mark).alias("_a"), F.max(mark).alias("_b")).filter("_a < _b").select("bucket")


def _mixed_only(work: Workspace, members: DataFrame, name: str) -> DataFrame:
    """The members of buckets that hold more than one class."""
    mixed = work.write(_mixed(members), f"{name}-mixed")
    return work.write(members.join(mixed, "bucket", "left_semi"), name)


def _sized(members: DataFrame) -> DataFrame:
    return members.join(members.groupBy("bucket").agg(F.count("*").alias("members")), "bucket")


def _lifted(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, root) of all nodes of either table, with the classes of `roots` merged as `merged` says."""
    upper = merged.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    moved = roots.join(upper, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return moved.unionByName(merged.join(moved.select("node"), "node", "left_anti"))


def _linked(work: Workspace, texts: DataFrame) -> DataFrame:
    """(node, root) of all texts(digest, n, keys, code) that have links."""
    texts_of = lambda roots, first, count: _rooted(texts.select("digest", "n", F.slice("keys", first, count).alias("keys")), roots).select("digest", "n", "root", F.explode("keys").alias("bucket"))

    # A few tables, by one pair per member, settle nearly all classes.
    links = _verified(work, _star(work, texts_of(None, 1, FIRST), "first"), texts, "first")
    roots = components(work, links, "roots-first")
    known = ["pairs-first"]
    release(work.spark)
    # Then buckets of all tables that still hold several classes.
    members = _mixed_only(work, texts_of(roots, 1, TABLES), "members")
    release(work.spark)
    roots = _settle_classes(work, members, roots, texts, known)
    pairs = work.write(_blocks(_mixed_only(work, _rooted(members.drop("root"), roots), "open"), texts), "met")
    found = _verified(work, pairs.distinct().join(_tried(work, known), ["a", "b"], "left_anti"), texts, "rest")
    return _joined(work, roots, found, "rest")


def classes(spark: SparkSession, docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, class_id, class_size, mark, alone, root for every row of docs.

    `root` (a digest, null if alone) names the class; class_id does not where ids are null or stand at different texts.
    """
    work = work or Workspace(spark, "omh")
    rows = work.write(sketches(docs), "sketches")
    once = rows.filter("digest IS NOT NULL").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "keys", "code")])
    texts, table = work.write_bucketed(once, "texts", "digest")
    release(spark)

    try:
        roots = _linked(work, texts)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    work.drop("texts")
    release(spark)
    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    ids = ids.filter("digest IS NOT NULL").join(roots, F.col("digest") == F.col("node"), "left").select("digest", "first_id", "copies", F.coalesce("root", "digest").alias("root"))
    ids = work.write(ids, "ids")
    release(spark)
    named = work.write(ids.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size")), "named")
    by_digest = work.write(ids.join(named, "root").select(F.col("digest").alias("_d"), "class_id", "class_size", "root"), "classes")
    out = rows.select("doc_id", "mark", "digest").join(by_digest, F.col("digest") == F.col("_d"), "left")
    alone = F.col("digest").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    size = F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long")
    return out.select("doc_id", class_id.alias("class_id"), size.alias("class_size"), "mark", alone.alias("alone"), "root")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least doc_id; all documents without words stay."""
    work = Workspace(spark, "omh")
    rows = work.write(classes(spark, docs, work), "classes-of-rows")
    work.drop("sketches")
    # By root, as several classes may have the class_id null or the same repeated doc_id.
    first = rows.filter("NOT alone").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("c")).select("c.doc_id", "c.mark", F.lit(False).alias("_alone"))
    chosen = work.write(first.unionByName(rows.filter("alone").select("doc_id", "mark", F.lit(True).alias("_alone")).distinct()), "chosen")
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_alone")
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64("text").alias("_text"))
    joined = marked.join(chosen, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark")))
    equal_rows = Window.partitionBy("_id", "_mark").orderBy("_alone")
    return joined.withColumn("_n", F.row_number().over(equal_rows)).filter("_alone OR _n = 1").select("_row.*")
