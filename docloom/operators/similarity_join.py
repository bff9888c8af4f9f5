"""Exact similarity joins of strings by the indel ratio, without comparing all pairs of a block.

The ratio of a and b is 100 * 2 * LCS / (len a + len b), so it reaches a threshold if and only if at most
(1 - threshold / 100) * (len a + len b) characters have to be inserted and deleted. One such edit takes away at most q of
a string's q-grams. Hence of any q * edits + 1 grams of a at least one is left in b, moved by at most `edits` places.
Each string is therefore indexed by so many of its grams only, those that are rarest in its block (its prefix, with all
grams as rare as the last one); strings that share none are never met. Lengths bound the edits: a partner is at most
2 / threshold - 1 times as long.

What is met is checked by length, place, and Spark's Levenshtein distance (never above the indel distance), and only then
measured in Python.

Blocks in which all grams are common (names of few syllables) would meet more often than they have pairs. Their strings are dealt
to cells of bounded size instead, and a cell compares its pairs by the counts of their characters, whose differences are never
above the indel distance; what is left is measured by bit-parallel rows, many pairs at a time.

Where only the most similar partner of a string is asked for, large blocks do not meet by grams at all: the strings of one
side are walked as tries, many strings of the other side at once, and a branch is left as soon as its beginning alone costs too
many edits. Most strings have a partner within a part of the edits; only those that have none go on to all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.sources.workspace import cut_lineage

#: Stands before a string's first character, so that every string has as many grams as characters.
PAD = "\x01"
_SLACK = 1e-9
#: Strings of one side of a cell, pairs that are held at once in it, and pairs of a cell that cost as much as one meeting by a gram.
CELL, TILE, PAIRS_A_MEETING = 2048, 1 << 20, 16
#: Strings of a cell that walk tries, strings in the tries of a cell, and walks that go on at once.
WALKERS, LEAVES, FRONT = 1 << 16, 1 << 17, 1 << 16
#: Parts of the edits that are allowed, one after the other, to strings that have no partner yet.
STAGES = (0.25, 0.5, 0.75, 1.0)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), with the LCS by bit-parallel rows."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)])


def most_edits(a: Column, b: Column, threshold: float) -> Column:
    """Insertions and deletions that strings of these lengths may differ by."""
    return F.floor((a + b) * ((100.0 - threshold) / 100.0) + _SLACK).cast("int")


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Native filter that never drops a pair of the threshold: Levenshtein distance is at most the indel distance."""
    return F.levenshtein(a, b) <= most_edits(F.length(a), F.length(b), threshold)


def _longest(n, threshold: float):
    return n * (200.0 / threshold - 1) + _SLACK


def gram_size(threshold: float) -> int:
    """The largest q of 1 and 2 with which strings of any length have enough grams; lengths up to 100 decide, as the share
    of grams needed only falls from there on by rounding."""
    for q in (2, 1):
        if all(q * int((n + int(_longest(n, threshold))) * (100 - threshold) / 100 + _SLACK) + 1 <= n for n in range(1, 100)):
            return q
    raise ValueError("the threshold is too low for a join by grams")


def _grams(rows: DataFrame, block: list[str], q: int) -> DataFrame:
    """block, s, n (its length), g, p: the grams with their places."""
    padded = F.concat(F.lit(PAD * (q - 1)), "s")
    spans = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.substring(padded, i + 1, F.lit(q)).alias("g"), i.alias("p")))
    return rows.withColumn("n", F.length("s")).filter("n > 0").select(*block, "s", "n", F.explode(spans).alias("x")).select(*block, "s", "n", "x.g", "x.p")


def _prefixes(grams: DataFrame, counts: DataFrame, block: list[str], threshold: float, q: int) -> DataFrame:
    """block, s, n, g, p of the rarest grams, as many as the most edits ask for."""
    need = q * most_edits(F.col("n"), F.floor(_longest(F.col("n"), threshold)), threshold) + 1
    held = grams.join(counts, [*block, "g"]).groupBy(*block, "s", "n").agg(F.array_sort(F.collect_list(F.struct("k", "g", "p"))).alias("all"))
    last = F.element_at("all", F.least(need, F.size("all")))
    few = F.filter("all", lambda x: (x["k"] < last["k"]) | ((x["k"] == last["k"]) & (x["g"] <= last["g"])))
    return held.select(*block, "s", "n", F.explode(few).alias("x")).select(*block, "s", "n", "x.g", "x.p")


def _bags(texts: list[str]) -> np.ndarray:
    """(2, n): counts of characters in 32 classes, up to four each, as bits; differing bits never outnumber the edits."""
    out = np.zeros((2, len(texts)), np.uint64)
    for i, s in enumerate(texts):
        seen: dict[int, int] = {}
        for c in s:
            k = ord(c) & 31
            seen[k] = seen.get(k, 0) + 1
        for k, n in seen.items():
            out[k >> 4, i] |= np.uint64(((1 << min(n, 4)) - 1) << 4 * (k & 15))
    return out


def _ratios(a: list[str], b: list[str], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """indel_ratio of a[ia] and b[ib]; texts `a` of up to 64 characters by rows of 64 bits."""
    out = np.empty(len(ia))
    la, lb = np.array([len(x) for x in a])[ia], np.array([len(x) for x in b])[ib]
    for i in np.flatnonzero((la > 64) | (lb > 256)):
        out[i] = indel_ratio(a[ia[i]], b[ib[i]])
    short = np.flatnonzero((la <= 64) & (lb <= 256))
    letters = {c: i for i, c in enumerate(sorted({c for x in a if len(x) <= 64 for c in x}))}
    places = np.zeros((len(a), len(letters) + 1), np.uint64)  # the last letter is one that `a` has not
    for i, x in enumerate(a):
        for j, c in enumerate(x if len(x) <= 64 else ""):
            places[i, letters[c]] |= np.uint64(1 << j)
    coded = np.full((len(b), max([len(x) for x in b if len(x) <= 256], default=0)), len(letters), np.int32)
    for i, x in enumerate(b):
        if len(x) <= 256:
            coded[i, : len(x)] = [letters.get(c, len(letters)) for c in x]
    for at in range(0, len(short), TILE // 8):
        part = short[at : at + TILE // 8]
        x, y = ia[part], ib[part]
        row = np.full(len(part), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j in range(int(lb[part].max(initial=0))):
            hit = row & places[x, coded[y, j]]
            row = (row + hit) | (row - hit)
        total = la[part] + lb[part]
        out[part] = np.where(total > 0, 200.0 * (64 - np.bitwise_count(row).astype(np.int64)) / np.maximum(total, 1), 100.0)
    return out


def cell_pairs(a: list[str], b: list[str], threshold: float, alone: bool, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices into the sorted lists a and b, and the ratios, of the different strings that reach the threshold; `alone`: a < b.

    `best` leaves one pair for each of a: the largest ratio, the least of b among equals.
    """
    bags_a, bags_b = _bags(a), _bags(b)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    most = np.floor(np.arange(la.max(initial=0) + lb.max(initial=0) + 1) * ((100.0 - threshold) / 100.0) + _SLACK).astype(np.int64)
    place = {x: i for i, x in enumerate(sorted({*a, *b}))}
    ra, rb = np.array([place[x] for x in a], np.int64), np.array([place[x] for x in b], np.int64)
    height = max(1, TILE // max(1, len(b)))
    parts = []
    for at in range(0, len(a), height):
        rows = slice(at, at + height)
        apart = np.bitwise_count(bags_a[0, rows, None] ^ bags_b[0]).astype(np.int64) + np.bitwise_count(bags_a[1, rows, None] ^ bags_b[1])
        limit = most[la[rows, None] + lb]
        ia, ib = np.nonzero((apart <= limit) & (np.abs(la[rows, None] - lb) <= limit))
        ia = ia + at
        wanted = ra[ia] < rb[ib] if alone else ra[ia] != rb[ib]
        ia, ib = ia[wanted], ib[wanted]
        ratios = _ratios(a, b, ia, ib)
        near = ratios >= threshold
        ia, ib, ratios = ia[near], ib[near], ratios[near]
        if best:
            order = np.lexsort((ib, -ratios, ia))
            first = order[np.unique(ia[order], return_index=True)[1]]
            ia, ib, ratios = ia[first], ib[first], ratios[first]
        parts.append((ia, ib, ratios))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.array([], int), np.array([], int), np.array([]))


class _Trie:
    """Different texts of one length, ascending: the nodes of each depth in order, with their letters and where their children begin."""

    def __init__(self, texts: list[str], letters: np.ndarray):
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), len(texts[0]))
        at = np.minimum(np.searchsorted(letters, raw), len(letters) - 1).astype(np.int32)
        code = np.where(letters[at] == raw, at, np.int32(len(letters)))
        new = np.ones(raw.shape, bool)
        new[1:] = np.logical_or.accumulate(raw[1:] != raw[:-1], axis=1)
        self.code, self.first = [], []
        held = np.zeros(1, np.int64)
        for depth in range(raw.shape[1]):
            starts = np.flatnonzero(new[:, depth])
            self.first.append(np.r_[np.searchsorted(starts, held), len(starts)].astype(np.int32))
            self.code.append(code[starts, depth])
            held = starts


def _walk(trie: _Trie, places: np.ndarray, who: np.ndarray, la: int, lb: int, most: int):
    """(parts of (walker, text of the trie, edits), steps): the texts of lb characters within `most` edits of the walkers `who` of la characters.

    places[walker, letter] are the places of a letter, as bits. With as many characters to come on both sides, those of the
    walker so far that have no partner cost an edit each, and as many more as the texts differ in length.
    """
    wide, flat, shift = places.shape[1], places.reshape(-1), lb - la
    found, steps = [], 0
    todo = [(0, x.astype(np.int32), np.zeros(len(x), np.int32), np.full(len(x), 0xFFFFFFFFFFFFFFFF, np.uint64)) for x in (who[lo : lo + FRONT // 4] for lo in range(0, len(who), FRONT // 4))]
    while todo:
        depth, w, node, row = todo.pop()
        while len(w) and depth < lb:
            low = trie.first[depth][node]
            n = trie.first[depth][node + 1] - low
            if (n != 1).any():
                place, number = _numbered(n)
                w, row, node = w[place], row[place], low[place] + number
            else:
                node = low
            steps += len(w)
            held = flat[w.astype(np.int64) * wide + trie.code[depth][node]]
            hit = row & held
            row = (row + hit) | (row - hit)
            depth += 1
            so_far = np.uint64((1 << min(max(depth - shift, 0), la)) - 1)
            near = np.flatnonzero(2 * np.bitwise_count(row & so_far).astype(np.int32) + shift <= most)
            w, node, row = w[near], node[near], row[near]
            if len(w) > FRONT and depth < lb:
                half = FRONT // 2
                todo += [(depth, w[lo : lo + half], node[lo : lo + half], row[lo : lo + half]) for lo in range(half, len(w), half)]
                w, node, row = w[:half], node[:half], row[:half]
        found.append((w, node, 2 * np.bitwise_count(row & np.uint64((1 << la) - 1)).astype(np.int64) + shift))
    return found, steps


def _numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): the place (0, 0, 2, 2, 2) and the number within it (0, 1, 0, 1, 2)."""
    place = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return place, np.arange(len(place), dtype=np.int32) - (np.cumsum(counts) - counts)[place].astype(np.int32)


class _Forest:
    """The texts b without an ending that all have, in tries by length, and walkers a without it; `back`: all from their ends."""

    def __init__(self, a: list[str], b: list[str], ending: int, threshold: float, back: bool):
        turn = (lambda x: x[: len(x) - ending][::-1]) if back else (lambda x: x[: len(x) - ending])
        self.a, self.texts, self.ending, self.threshold = [turn(x) for x in a], [turn(x) for x in b], ending, threshold
        self.letters = np.array(sorted({ord(c) for x in self.a for c in x}) or [0], np.uint32)
        self.by_length: dict[int, list[int]] = {}
        for i in sorted(range(len(b)), key=self.texts.__getitem__):
            self.by_length.setdefault(len(self.texts[i]), []).append(i)
        self.tries: dict[int, _Trie] = {}

    def near(self, who: np.ndarray, la: int, part: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(ia, ib, ratios, steps): the texts within a part of the edits of the walkers `who`, which have la characters here."""
        places = np.zeros((len(who), len(self.letters) + 1), np.uint64)  # the last letter is one that no walker has
        if la:
            raw = np.frombuffer("".join(self.a[i] for i in who).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(who), la)
            for j in range(la):
                places[np.arange(len(who)), np.searchsorted(self.letters, raw[:, j])] |= np.uint64(1 << j)
        parts, steps = [(np.zeros(0, np.int64),) * 3], 0
        for lb, index in self.by_length.items():
            total = la + lb + 2 * self.ending
            most = int(np.floor(total * part * ((100.0 - self.threshold) / 100.0) + _SLACK))
            if abs(lb - la) > most:
                continue
            if lb not in self.tries:
                self.tries[lb] = _Trie([self.texts[i] for i in index], self.letters)
            found, taken = _walk(self.tries[lb], places, np.arange(len(who)), la, lb, most)
            steps += taken
            for w, leaf, edits in found:
                parts.append((who[w], np.array(index, np.int64)[leaf], 100.0 * (total - edits) / total))
        ia, ib, ratios = (np.concatenate(x) for x in zip(*parts))
        return ia, ib, ratios, steps


def best_pairs(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cell_pairs with `best` and without `alone`, by tries; strings of a that b holds, too, are left out, as they are their own best."""
    held = set(b)
    ends = [x[::-1] for x in (*a, *b)]
    least, largest = min(ends, default=""), max(ends, default="")
    ending = next((i for i, (x, y) in enumerate(zip(least, largest)) if x != y), min(len(least), len(largest)))
    mine = np.array([i for i, x in enumerate(a) if x not in held], np.int64)
    lengths = np.array([len(a[i]) - ending for i in mine], np.int64)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def keep(ia, ib, ratios):
        order = np.lexsort((ib, -ratios, ia))
        first = order[np.unique(ia[order], return_index=True)[1]]
        parts.append((ia[first], ib[first], ratios[first]))

    long, short = mine[lengths > 64], mine[lengths <= 64]
    if len(long):
        ia, ib, ratios = cell_pairs([a[i] for i in long], b, threshold, False, True)
        keep(long[ia], ib, ratios)
    if len(short) and b:
        lengths = lengths[lengths <= 64]
        local = [a[i] for i in short]
        forests = [_Forest(local, b, ending, threshold, back) for back in (False, True)]
        some = np.unique(np.linspace(0, len(short) - 1, 32).astype(np.int64))
        steps = [sum(f.near(some[lengths[some] == la], int(la), 1.0)[3] for la in np.unique(lengths[some])) for f in forests]
        forest = forests[int(steps[1] < steps[0])]
        height = max(1, TILE * 4 // (len(forest.letters) + 1))
        for la in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == la)
            for todo in (same[lo : lo + height] for lo in range(0, len(same), height)):
                for part in STAGES:
                    ia, ib, ratios, _ = forest.near(todo, la, part)
                    near = ratios >= (threshold if part == 1 else 100.0 - part * (100.0 - threshold))
                    keep(short[ia[near]], ib[near], ratios[near])
                    todo = np.setdiff1d(todo, ia[near])
    return tuple(np.concatenate(x) for x in zip(*parts))


def _in_cells(left: DataFrame, right: DataFrame, sizes: DataFrame, block: list[str], pairs, of_left: int, of_right: int) -> DataFrame:
    """block, a, b, ratio of blocks sizes(block.., na, nb): each string of one side goes to the cells of all strings of the other.

    `pairs` compares a cell's sorted lists; `of_left` and `of_right` are the strings of a side of a cell.
    """
    cells = lambda n: F.ceil(F.col(n) / {"na": of_left, "nb": of_right}[n]).cast("int")
    deal = lambda rows, mine, other, i, j, side: (
        rows.join(sizes, block).withColumn(i, F.pmod(F.xxhash64("s"), cells(mine)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), cells(other) - 1))).select(*block, "_i", "_j", F.lit(side).alias("_side"), "s")
    )
    rows = deal(left, "na", "nb", "_i", "_j", 0).unionByName(deal(right, "nb", "na", "_j", "_i", 1))
    kept = [left.schema[c] for c in block]

    def compare(table: pa.Table) -> pa.Table:
        side, s = table["_side"].to_numpy(), table["s"].to_pylist()
        a, b = (sorted(x for x, k in zip(s, side) if k == which) for which in (0, 1))
        ia, ib, ratios = pairs(a, b)
        keys = [pa.repeat(table[c][0], len(ia)) for c in block]
        return pa.table([*keys, pa.array([a[i] for i in ia], pa.string()), pa.array([b[i] for i in ib], pa.string()), pa.array(ratios, pa.float64())], names=[*block, "a", "b", "ratio"])

    schema = T.StructType([*kept, T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("ratio", T.DoubleType())])
    return rows.groupBy(*block, "_i", "_j").applyInArrow(compare, schema)


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 88, block: list[str] | None = None, best: bool = False) -> DataFrame:
    """left(s, block..), right(s, block..) to the pairs (block.., a, b, ratio) of one block whose ratio reaches the threshold.

    Each pair of different texts comes once a block, equal strings of both sides too, with ratio 100. Without `right`
    left is joined with itself, then a < b and equal strings are no pair. Null strings and null blocks have no partner; two empty strings
    are equal. With `best` pairs may be left out that are not a's most similar one, the least b among equals.
    """
    named = block or []
    block = [f"_block{i}" for i in range(len(named))]  # the caller's names cannot clash with those used here
    if not named:
        left, named, block = left.withColumn("_all", F.lit(0)), ["_all"], ["_block0"]
        right = None if right is None else right.withColumn("_all", F.lit(0))
        return similar_pairs(left, right, threshold, named, best).drop("_all")
    q = gram_size(threshold)
    alone = right is None
    texts = lambda rows: rows.select(*[F.col(c).alias(k) for c, k in zip(named, block)], "s").filter("s IS NOT NULL").distinct()
    mine = texts(left)
    other = mine if alone else texts(right)
    whole, cells = (mine, other), None
    size = lambda rows, k: rows.groupBy(*block).agg(F.count("*").alias(k))
    if best and not alone:
        large = size(mine, "na").join(size(other, "nb"), block).filter(F.col("na").cast("double") * F.col("nb") > CELL * CELL)
        large = F.broadcast(cut_lineage(large))  # at most a row for 2 * CELL strings
        cells = _in_cells(mine, other, large, block, lambda x, y: best_pairs(x, y, threshold), WALKERS, LEAVES)
        mine, other = (x.join(large, block, "left_anti") for x in whole)
    a, b = _grams(mine, block, q), _grams(other, block, q)
    counts = (a if alone else a.unionByName(b)).groupBy(*block, "g").agg(F.count("*").alias("k"))
    ga = _prefixes(a, counts, block, threshold, q).select(*block, "g", F.col("s").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    gb = _prefixes(b, counts, block, threshold, q).select(*block, "g", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    held = lambda rows, k: rows.groupBy(*block, "g").agg(F.count("*").cast("double").alias(k))
    meetings = held(ga, "x").join(held(gb, "y"), [*block, "g"]).groupBy(*block).agg(F.sum(F.col("x") * F.col("y")).alias("met"))
    sizes = size(mine, "na").join(size(other, "nb"), block).join(meetings, block)
    crowded = cut_lineage(sizes.filter(F.col("met") * PAIRS_A_MEETING > F.col("na").cast("double") * F.col("nb") + CELL * CELL).select(*block, "na", "nb"))
    crossed = _in_cells(mine, other, crowded, block, lambda x, y: cell_pairs(x, y, threshold, alone, best), CELL, CELL)
    ga, gb = (x.join(crowded, block, "left_anti") for x in (ga, gb))
    edits = most_edits(F.col("na"), F.col("nb"), threshold)
    near = (F.abs(F.col("na") - F.col("nb")) <= edits) & (F.abs(F.col("pa") - F.col("pb")) <= edits)
    met = ga.join(gb, [*block, "g"]).filter(near & ((F.col("a") < F.col("b")) if alone else (F.col("a") != F.col("b")))).select(*block, "a", "b").distinct()
    found = met.filter(may_reach(F.col("a"), F.col("b"), threshold)).withColumn("ratio", ratio("a", "b")).filter(F.col("ratio") >= threshold)
    found = found.unionByName(crossed) if cells is None else found.unionByName(crossed).unionByName(cells)
    named_again = dict(zip(block, named))
    if alone:
        return found.withColumnsRenamed(named_again)
    same = whole[0].join(whole[1], [*block, "s"]).select(*block, F.col("s").alias("a"), F.col("s").alias("b"), F.lit(100.0).alias("ratio"))
    return found.unionByName(same).withColumnsRenamed(named_again)
