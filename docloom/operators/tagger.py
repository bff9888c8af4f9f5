"""A tagger of names that is trained here: an averaged perceptron over hashed features with Viterbi decoding.

Every word gets a tag: the beginning or the inside of a name of a type, or none. A text's tags are those of the best path
by the words' scores and the scores of neighbouring tags; an inside never follows anything but its own type. Training texts are
marked by names that are known; at most MAX_TRAIN of them are used, those with the least hash, so training on the driver is bounded.
The model is an array of 2^BITS rows, sent to the tasks once.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import answering, matching

BITS = 16
MAX_TRAIN = 1500
EPOCHS = 4
TAGS = ["O", *(f"{p}-{t}" for t in fixed.ENTITY_TYPES for p in "BI")]
_TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
_NEVER = np.float32(-1e9)


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c for c in word))


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """(words, features) of rows of the model."""
    words = ["", "", *(text[a:b] for a, b in spans), "", ""]
    shapes = [_shape(w) for w in words]
    out = []
    for i in range(2, len(words) - 2):
        w = words[i].lower()
        named = ["bias", f"w={w}", f"s={w[-3:]}", f"p={w[:3]}", f"x={shapes[i]}", f"-1={words[i - 1].lower()}", f"+1={words[i + 1].lower()}", f"-2={words[i - 2].lower()}", f"xx={shapes[i - 1]}|{shapes[i]}|{shapes[i + 1]}", f"s-1={words[i - 1].lower()[-3:]}|{shapes[i]}", f"e+1={shapes[i]}|{words[i + 1].lower()}"]
        out.append([zlib.crc32(n.encode()) & (2**BITS - 1) for n in named])
    return np.array(out, np.int64) if out else np.zeros((0, 1), np.int64)


def _allowed() -> np.ndarray:
    """(tags + 1, tags): 0 where a tag may follow another, or the start in the last row; else very low."""
    out = np.zeros((len(TAGS) + 1, len(TAGS)), np.float32)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            out[[i for i, before in enumerate([*TAGS, "start"]) if before[1:] != tag[1:]], j] = _NEVER
    return out


ALLOWED = _allowed()


def viterbi(scores: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The best path through scores (words, tags) with follow (tags + 1, tags), the start in its last row; lower tags win ties."""
    n, back = len(scores), []
    if not n:
        return np.zeros(0, np.int64)
    best = scores[0] + follow[-1]
    for row in scores[1:]:
        reach = best[:, None] + follow[:-1]
        back.append(reach.argmax(0))
        best = reach.max(0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


class Tagger:
    def __init__(self, weight: np.ndarray, follow: np.ndarray):
        self.weight, self.follow = weight, follow

    def path(self, rows: np.ndarray) -> np.ndarray:
        return viterbi(self.weight[rows].sum(1), self.follow + ALLOWED)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of the names in a text."""
        held = tokens(text)
        out: list[tuple[int, int, str]] = []
        for (a, b), tag in zip(held, self.path(features(text, held))):
            name = TAGS[tag]
            if name[0] == "B":
                out.append((a, b, name[2:]))
            elif name[0] == "I":
                out[-1] = (out[-1][0], b, name[2:])
        return out

    def __call__(self, text: str) -> list[tuple[str, str]]:
        return [(text[a:b], kind) for a, b, kind in self.spans(text)]


def gold_tags(text: str, spans: list[tuple[int, int]], names: list[tuple[int, int, str]]) -> np.ndarray:
    """The tag of each word under (start, end, type) of the names in a text."""
    out = np.zeros(len(spans), np.int64)
    for start, end, kind in names:
        inside = [i for i, (a, b) in enumerate(spans) if start <= a and b <= end]
        for n, i in enumerate(inside):
            out[i] = TAGS.index(f"{'BI'[n > 0]}-{kind}")
    return out


def fit(marked: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, seed: int = 5) -> Tagger:
    """An averaged perceptron of (text, names); the order of the texts does not matter."""
    made = []
    for text, names in sorted(marked):
        held = tokens(text)
        made.append((features(text, held), gold_tags(text, held, names)))
    now = Tagger(np.zeros((2**BITS, len(TAGS)), np.float32), np.zeros((len(TAGS) + 1, len(TAGS)), np.float32))
    total, total_follow = np.zeros_like(now.weight, np.float64), np.zeros_like(now.follow, np.float64)
    order, seen = random.Random(seed), 0
    for _ in range(epochs):
        order.shuffle(made)
        for rows, gold in made:
            seen += 1
            path = now.path(rows)
            wrong = np.flatnonzero(path != gold)
            if not len(wrong):
                continue
            for i in wrong:
                for tag, step in ((gold[i], 1), (path[i], -1)):
                    np.add.at(now.weight, (rows[i], tag), step)
                    np.add.at(total, (rows[i], tag), step * seen)
            for tags, step in ((gold, 1), (path, -1)):
                before = np.concatenate([[len(TAGS)], tags[:-1]])
                np.add.at(now.follow, (before, tags), step)
                np.add.at(total_follow, (before, tags), step * seen)
    # What was added at step t counts for the steps after it.
    last = max(1, seen + 1)
    return Tagger((now.weight - total / last).astype(np.float32), (now.follow - total_follow / last).astype(np.float32))


def mark(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts(id, text), names(name, type) to (id, text, names): the places of known names, longest first, as training needs them."""
    typed = names.select("name", F.col("type").alias("entity_id"))
    found = matching.match_entities(texts.select(F.col("id").alias("question_id"), "text"), typed, min_length=2)
    listed = found.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("entity_id").alias("type")))).alias("names"))
    return texts.select("id", "text").join(listed, "id")


def train(marked: DataFrame, limit: int = MAX_TRAIN) -> Tagger:
    """A tagger of at most `limit` rows of marked(id, text, names), those with the least hash of their id."""
    rows = marked.orderBy(F.xxhash64("id"), "id").limit(limit).collect()
    return fit([(r.text, [(x.start, x.end, x.type) for x in r.names]) for r in rows])


def tag(chunks: DataFrame, model: Tagger) -> DataFrame:
    """chunks(chunk_id, doc_id, text) to mentions."""
    held = chunks.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows of TAGS numbers
    return answering.tag(chunks, lambda: held.value)
