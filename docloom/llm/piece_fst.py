"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file and composed with each input.

 * The normaliser maps a text to symbols. The character map of the model is a tree of byte strings
   with their replacements; at each place the longest rule is taken, and what no rule holds is
   passed on. Then, as the model says, runs of spaces shrink, a space becomes the mark U+2581 and
   one mark goes in front of a text that is not empty.
 * The lexicon maps symbols to pieces: an arc from position s to position e for each piece that
   spells symbols s..e. A symbol that no piece spells gets one arc of its UTF-8 byte pieces.
 * The grammar weighs sequences of pieces. For a unigram model an arc costs minus its score. For a
   BPE model a pair of neighbouring pieces costs 0 if merging their joint symbols by score,
   leftmost of equals first, ends in just these two pieces, and infinity otherwise. A sequence is
   the BPE segmentation exactly if all its neighbouring pairs are, and every prefix has exactly
   one such sequence, so after composition one last piece survives at each position.

The shortest path in the tropical semiring (min, +) is found by one sweep over the positions in
order for either kind: the distance of a state is the least sum of a distance before it and the
weight of the arc. States are positions for a unigram model, and positions with the last piece for
a BPE model, of which one at most has a finite distance. No piece holds a mark after another symbol,
and no piece holds an unspelt symbol, so the lattice of a text falls apart at these places and its
shortest path is that of the parts in a row; parts met before are looked up. The same holds before
signs that no piece holds after a letter. The pair costs are computed when first needed and kept.

Decoding is the inverse projection: pieces to symbols, byte pieces to bytes, marks to spaces, the
mark in front dropped; bytes that are not UTF-8 become U+FFFD.

Defined cases: a null or empty text has no pieces; a mark that stands in the text itself decodes
to a space; repeated rows encode alike; texts are encoded whole; an empty table gives an empty
result; texts of any length and columns of any name are taken. With a character map `exact` means that
decoding gives the normalised text.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_INF = float("inf")
KEPT_PARTS = 700_000
KEPT_PAIRS = 600_000


def read_model(path: str) -> dict:
    """What the transducers need of a model file: some 700 KB for 32,000 pieces."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only marks before words are supported")
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    kept = {"map": spec.precompiled_charsmap, "shrink": spec.remove_extra_whitespaces, "prefix": spec.add_dummy_prefix}
    return kept | {"pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "types": [p.type for p in m.pieces], "bpe": m.trainer_spec.model_type == 2}


class Normaliser:
    """A character map as a transducer: states are beginnings of rules, a final state puts out its replacement."""

    def __init__(self, charsmap: bytes):
        self.rules: dict[str, str] = {}
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            units, texts = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist(), charsmap[4 + size :]
            self._read(units, texts)
        self.begins: dict[str, str | None] = {}
        for rule, new in self.rules.items():
            for k in range(1, len(rule)):
                self.begins.setdefault(rule[:k], None)
            self.begins[rule] = new
        first = {r[0] for r in self.begins}
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(first))) + "]") if first else None

    def _read(self, units: list[int], texts: bytes) -> None:
        """All rules of a double array: a unit holds a label in its low byte, the place of its children, and whether a value follows."""
        below = lambda u: (u >> 10) << ((u & 512) >> 6)
        todo = [(below(units[0]), b"")]
        while todo:
            base, key = todo.pop()
            for label in range(1, 256):
                at = base ^ label
                if at >= len(units) or units[at] & 0x800000FF != label:
                    continue
                child = at ^ below(units[at])
                if units[at] >> 8 & 1:
                    value = units[child] & 0x7FFFFFFF
                    self.rules[(key + bytes([label])).decode()] = texts[value : texts.index(b"\0", value)].decode()
                todo.append((child, key + bytes([label])))

    def __call__(self, text: str) -> str:
        if self.starts is None:
            return text
        out, at, n = [], 0, len(text)
        while m := self.starts.search(text, at):
            start, best, end = m.start(), None, m.start() + 1
            k = end
            while k <= n and (rule := text[start:k]) in self.begins:
                if self.begins[rule] is not None:
                    best, end = self.begins[rule], k
                k += 1
            out += [text[at:start], text[start:end] if best is None else best]
            at = end
        return "".join([*out, text[at:]])


class _Known(dict):
    """The pieces of parts met before; those of others are found, and kept if the part is short."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, part: str) -> tuple[int, ...]:
        got = self.find(part)
        if len(part) <= 64:  # longer parts hardly come again
            if len(self) >= KEPT_PARTS:
                self.clear()
            self[part] = got
        return got


class Transducer:
    def __init__(self, model: dict):
        self.pieces, self.scores, types = model["pieces"], model["scores"], model["types"]
        self.bpe, self.prefix, self.shrink = model["bpe"], model["prefix"], model.get("shrink", False)
        self.mapped = Normaliser(model.get("map", b""))
        self.lexicon = {p: i for i, (p, t) in enumerate(zip(self.pieces, types)) if t in (_NORMAL, _USER)}
        self.byte = [0] * 256
        for i, (p, t) in enumerate(zip(self.pieces, types)):
            if t == _BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.symbols = set("".join(self.lexicon))
        self.unspelt = -min(self.scores) + 10.0
        if any(MARK in p.lstrip(MARK) for p in self.lexicon):
            raise ValueError("a piece holds a mark after another symbol")
        # Line ends are cut off as parts of their own where no piece spells them.
        lone = "\n" if "\n" not in self.symbols else ""
        self.part = re.compile(f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" + (f"|{lone}" if lone else ""))
        # ASCII signs that no piece holds after a letter or digit: a part falls apart before them, too.
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
        self.tail = "".join(sorted(signs - {b for p in self.lexicon for a, b in zip(p, p[1:]) if a.isalnum()}))
        if self.bpe:  # a piece that its own merges do not make never comes out
            self.lexicon = {p: i for p, i in self.lexicon.items() if len(p) == 1 or self._merge(p) == [p]}
        # The lexicon as a tree of beginnings: a beginning that is no piece itself holds -1.
        self.begins = {p[:k]: -1 for p in self.lexicon for k in range(1, len(p))} | self.lexicon
        # The same tree by symbols: a symbol leads to a piece or -1, and to the symbols after it.
        self.tree: dict[str, tuple[int, dict]] = {}
        nodes = {"": self.tree}
        for p in sorted(self.begins, key=len):
            nodes[p] = {}
            nodes[p[:-1]][p[-1]] = self.begins[p], nodes[p]
        self.bytes_of = [self._bytes_of(p, t) for p, t in zip(self.pieces, types)]
        self.pairs: dict[int, bool] = {}
        self.known = _Known(self._pieces_of)

    def _bytes_of(self, piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == _CONTROL:
            return b""
        return " ⁇ ".encode() if kind == _UNKNOWN else piece.replace(MARK, " ").encode()

    def _merge(self, text: str, wall: int = 0) -> list[str] | None:
        """Merge neighbours with the best score, leftmost of equals first, while any join is a piece.

        With a wall, None as soon as a merge crosses it: the symbol before the wall is then joined to the one after it.
        """
        parts, lexicon, scores = list(text), self.lexicon, self.scores
        cost = [-_INF if (k := lexicon.get(a + b)) is None else scores[k] for a, b in zip(parts, parts[1:])]
        while cost:
            best = max(cost)
            if best == -_INF:
                break
            at = cost.index(best)
            if wall:
                if at == wall - 1:
                    return None
                if at < wall - 1:
                    wall -= 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del cost[at]
            if at < len(cost):
                cost[at] = -_INF if (k := lexicon.get(parts[at] + parts[at + 1])) is None else scores[k]
            if at:
                cost[at - 1] = -_INF if (k := lexicon.get(parts[at - 1] + parts[at])) is None else scores[k]
        return parts

    def allowed(self, left: int, right: int) -> bool:
        """Whether the pair costs 0: a merge never crosses the place where the two pieces meet."""
        key = left << 20 | right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            got = self.pairs[key] = self._merge(a + b, len(a)) == [a, b]
        return got

    def _arcs(self, part: str, start: int) -> list[tuple[int, int]]:
        """(end, piece) arcs of the lattice from `start`, shortest first; an unspelt symbol is the piece -1."""
        out, begins, n = [], self.begins, len(part)
        end = start + 1
        while end <= n:
            i = begins.get(part[start:end])
            if i is None:
                break
            if i >= 0:
                out.append((end, i))
            end += 1
        if not out:
            out.append((start + 1, -1))
        return out

    def _bytes(self, symbols: str) -> list[int]:
        return [self.byte[b] for b in symbols.encode("utf-8", "replace")]

    def shortest_path(self, part: str) -> tuple[int, ...]:
        """The pieces of one part of the lattice: distances of states in order of position, then the way back."""
        whole = self.lexicon.get(part)
        if whole is not None and self.bpe:
            return (whole,)
        n = len(part)
        back = self._sweep_pairs(part, n) if self.bpe else self._sweep_scores(part, n)
        out, at = [], n
        while at:
            start, i = back[at]
            out.append([i] if i >= 0 else self._bytes(part[start:at]))
            at = start
        return tuple(chain.from_iterable(reversed(out)))

    def _sweep_pairs(self, part: str, n: int) -> list:
        """A state's last arc (where it starts, its piece) for pair costs: 0 or infinite, so a state at distance 0 cannot be bettered."""
        back: list = [None] * (n + 1)  # None: distance infinite
        back[0] = 0, -2
        known = self.pairs.get
        for start in range(n):
            if back[start] is None:
                continue
            last, spelt, node = back[start][1], False, self.tree
            left = last << 20
            for end in range(start, n):
                got = node.get(part[end])
                if got is None:
                    break
                i, node = got
                if i >= 0:
                    spelt = True
                    if back[end + 1] is None:
                        if last < 0:
                            back[end + 1] = start, i
                        else:
                            ok = known(left | i)
                            if self.allowed(last, i) if ok is None else ok:
                                back[end + 1] = start, i
            if not spelt and back[start + 1] is None:
                back[start + 1] = start, -1
        return back

    def _sweep_scores(self, part: str, n: int) -> list:
        """The same where an arc costs minus its score."""
        scores = self.scores
        dist, back = [0.0] + [_INF] * n, [(0, -2)] * (n + 1)
        for start in range(n):
            before = dist[start]
            for end, i in self._arcs(part, start):
                cost = before + (self.unspelt if i < 0 else -scores[i])
                if cost < dist[end]:
                    dist[end], back[end] = cost, (start, i)
            if before + self.unspelt < dist[start + 1]:
                dist[start + 1], back[start + 1] = before + self.unspelt, (start, -1)
        return back

    def symbols_of(self, text: str) -> str:
        """The normalised text, with spaces as spaces."""
        text = self.mapped(text)
        return re.sub(" +", " ", text).strip(" ") if self.shrink else text

    def normalise(self, text: str) -> str:
        text = self.symbols_of(text)
        return (MARK if self.prefix else "") + text.replace(" ", MARK) if text else ""

    def _pieces_of(self, part: str) -> tuple[int, ...]:
        word = part.rstrip(self.tail)
        if len(word) < len(part) and word and word[-1].isalnum():
            return self.known[word] + self.known[part[len(word) :]]
        return self.shortest_path(part)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, self.part.findall(self.normalise(text)))), np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_HELD: dict[int, Transducer] = {}


def _transducer(model) -> Transducer:
    """One compiled transducer for each worker process and broadcast."""
    if model.value["key"] not in _HELD:
        _HELD.clear()
        _HELD[model.value["key"]] = Transducer(model.value)
    return _HELD[model.value["key"]]


def _broadcast(spark, path: str):
    model = read_model(path)  # the size of a model file, whatever the data
    return spark.sparkContext.broadcast(model | {"key": hash((path, len(model["pieces"]), sum(model["scores"])))})


def _with_column(docs: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = docs.select(*[c for c in docs.columns if c != name])
    return kept, T.StructType([*kept.schema.fields, T.StructField(name, kind)])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(docs: DataFrame, model_file: str = MODEL, check: bool = False) -> DataFrame:
    """The columns of docs with `ids` (array of int) added, and with check=True `exact`: decoding gives the text again."""
    model = _broadcast(docs.sparkSession, model_file)
    kept, schema = _with_column(docs, "ids", T.ArrayType(T.IntegerType()))
    if check:
        kept = kept.drop("exact")
        schema = T.StructType([*[f for f in schema.fields if f.name != "exact"], T.StructField("exact", T.BooleanType())])
    at = kept.columns.index("text")

    def run(batches):
        t = _transducer(model)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [x.as_py() or "" for x in part.column(at)]
                rows = [t.encode(x) for x in texts]
                more = [pa.array([t.decode(r.tolist()) == t.symbols_of(x).replace(MARK, " ") for r, x in zip(rows, texts)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(rows), *more], schema.names)

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str = MODEL) -> DataFrame:
    """The columns of rows(.., ids) with `text` added (null ids give a null text)."""
    model = _broadcast(rows.sparkSession, model_file)
    kept, schema = _with_column(rows, "text", T.StringType())
    at = kept.columns.index("ids")

    def run(batches):
        t = _transducer(model)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [None if x.as_py() is None else t.decode(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(run, schema)


def digest(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, exact for every document."""
    return encode(docs.select("doc_id", "text"), model_file, check=True).select("doc_id", "ids", F.size("ids").alias("n_tokens"), "exact")
