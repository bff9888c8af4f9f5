"""Language identification, importance resampling and vector codes against brute force and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import importance, language_id, vector_codes
from docloom.llm.common import utf8_groups

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- 11 -----------------------------------------------------------------------------------------------------------------


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 30):
        code = language_id.codewords(n)
        assert code.shape[0] == n and (np.abs(code.sum(0)) < n).all()
        assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1]  # no two bits are alike
        apart = (code.shape[1] - code.astype(int) @ code.T)[~np.eye(n, dtype=bool)] / 2
        assert apart.min() >= max(1, code.shape[1] / 4)
    assert language_id.codewords(0).shape == (0, 0) and language_id.codewords(1).shape == (1, 0)


def brute_grams(text):
    data = [b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in (text or "").encode()]
    out = []
    for n in range(1, language_id.ORDERS + 1):
        for i in range(len(data) - n + 1):
            value = 0
            for b in data[i : i + n]:
                value = (value * 257 + b + 1) % 2**32
            out.append((value * 2654435761 % 2**32 >> 16) % language_id.BUCKETS)
    return np.bincount(out, minlength=language_id.BUCKETS)


@pytest.mark.parametrize("size", [3, 17, 1_000_000])
def test_grams_match_brute_force(monkeypatch, size):
    monkeypatch.setattr(language_id, "SLICE", size)
    r = random.Random(3)
    texts = ["", "A", "Éa", "ab, CD"] + ["".join(r.choice("aBé -\n日") for _ in range(r.randint(0, 60))) for _ in range(40)] + [""]
    got = np.zeros((len(texts), language_id.BUCKETS), np.int64)
    for lo, hi, data, offsets in utf8_groups(pa.array(texts), 500):
        got[lo:hi] = language_id.text_counts(data, offsets)
    for row, text in zip(got, texts):
        assert (row == brute_grams(text)).all(), text


def test_decoding_matches_brute_force():
    code = language_id.codewords(4)
    r = np.random.default_rng(2)
    trust = r.uniform(0.5, 1.5, code.shape)
    model = language_id.Model(list("abcd"), code, np.zeros((1, code.shape[1])), trust)
    margins = r.normal(0, 3, (50, code.shape[1]))
    best, score, unsure = model.decode(margins)
    for i, m in enumerate(margins):
        loss = [sum(trust[k][b] * math.log1p(math.exp(-code[k][b] * m[b])) for b in range(len(m))) for k in range(4)]
        share = sorted((math.exp(-x) / sum(math.exp(-y) for y in loss) for x in loss), reverse=True)
        assert best[i] == min(range(4), key=lambda k: loss[k])
        assert score[i] == pytest.approx(share[0]) and unsure[i] == (share[0] - share[1] < language_id.AMBIGUOUS)


def test_held_out_languages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "der die das " * 5 if i % 2 else "the of and " * 5, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else ("de" if i % 2 else "en")) for i in range(200)], "doc_id long, text string, lang string")
    rows = language_id.identify(docs).collect()
    assert {r.lang_pred for r in rows} == {"de", "en"} and all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in rows)


def test_languages_on_odd_rows(spark):
    rows = [(None, "the end", "en"), (1, None, "en"), (2, "", "de"), (3, "12 + 3", "de"), (4, "der Hund " * 200_000, "de"), (4, "der Hund", "de"), (6, "the dog and the cat", "en"), (7, "the dog and the cat", "en"), (8, "chien", None), (9, "Ж", "ru")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert unknown == {1, 2, 3} and all(r.score == 0 and r.ambiguous for r in got if r.lang_pred == "und")
    by = {r.doc_id: r for r in got}
    assert by[4].lang_pred == "de" and by[6].lang_pred == by[7].lang_pred == "en" and by[6].score == by[7].score and not by[None].held_out
    assert language_id.identify(docs.limit(0)).count() == 0
    none = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"}
    one = docs.filter("lang = 'de'")
    assert {(r.lang_pred, r.score) for r in language_id.identify(one).collect()} == {("de", 1.0), ("und", 0.0)}


# --- 12 -----------------------------------------------------------------------------------------------------------------


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_features(text):
    w = words(text)
    return sorted(zlib.crc32(" ".join(w[i : i + n]).encode()) % importance.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1))


@pytest.mark.parametrize("limit, run", [(2_000_000, 200_000), (60, 3), (1, 1)])
def test_features_match_brute_force(limit, run):
    r = random.Random(1)
    texts = ["", "Ab cd  EF", "a", "é ñ-x 9Z", "word" * 50 + " b " + "q" * 33 + " " + "z" * 32 + " " + "y" * 64, None, "x " * 5, "A" * 5000, "日本 語"]
    texts += ["".join(r.choice("aB é0-\n日") for _ in range(r.randint(0, 200))) for _ in range(100)]
    got = [[] for _ in texts]
    for lo, _, data, offsets in utf8_groups(pa.array(["before", *texts]).slice(1), limit):
        for text, bucket, held in importance.features(data, offsets, run):
            for k in range(3):
                for t, b, h in zip(text, bucket[k], held[k]):
                    if h:
                        got[lo + t].append(int(b))
    assert [sorted(g) for g in got] == [brute_features(t) for t in texts]


def brute_ranks(docs, target):
    size = importance.BUCKETS
    s, t = (np.bincount([b for x in rows for b in brute_features(x)], minlength=size) for rows in ([d for _, d in docs], target))
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + size) / ((x + 1) * (t.sum() + size)))) for x, y in zip(s.tolist(), t.tolist())]
    out = []
    for i, text in docs:
        own = brute_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((-x[3], -1 if x[0] is None else x[0]) for x in out if x[4] >= 20)
    drawn = {x[1]: n + 1 for n, x in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((x[0], *x[1:4], drawn.get(-1 if x[0] is None else x[0])) for x in out), key=str)


def test_resampling_matches_brute_force(spark):
    r = random.Random(7)
    pool = ["alpha", "beta", "Gamma", "été", "x1"] + ["w" * 40]
    docs = [(i, " ".join(r.choice(pool) for _ in range(r.randint(15, 60)))) for i in range(300)] + [(None, "beta " * 30), (400, None), (401, ""), (402, "é " * 300_000), (403, "A" * 300_000)]
    target = ["alpha alpha beta", None, "", "gamma x1 alpha"] * 3
    frame = spark.createDataFrame([(i, t, 7, "r") for i, t in docs], "doc_id long, text string, rank long, _row string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.rank(spark, frame, bench, keep=["doc_id", "rank", "_row"])
    assert got.columns == ["doc_id", "_row", "n_features", "weight", "score", "rank"]
    want = brute_ranks(docs, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=str) == want
    drawn = importance.sample(spark, frame, bench)
    assert drawn.columns == frame.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(x[0] for x in want if x[4])


def test_resampling_of_ties_and_nothing(spark):
    docs = spark.createDataFrame([(5, "a b c d " * 10)] * 40, "doc_id long, text string")
    empty = docs.limit(0).select("text")
    got = importance.rank(spark, docs, empty).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2] and len(got) == 40
    assert importance.rank(spark, docs.limit(0), docs).count() == 0


# --- 13 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, d, high", [(64, 4, 60), (64, 4, 3), (64, 2, 2), (1, 4, 5), (5, 1, 2), (9, 7, 1)])
def test_tree_matches_brute_force(n, d, high):
    r = np.random.default_rng(n * d)
    points, x = r.integers(-high, high + 1, (n, d)), r.integers(-high - 2, high + 3, (3000, d))
    at, far = vector_codes.Tree.build(points).nearest(x)
    all_far = ((x[:, None] - points[None]) ** 2).sum(2)
    assert (at == all_far.argmin(1)).all() and (far == all_far.min(1)).all()  # argmin takes the lower index


def brute_codes(rows):
    usual = [x for x in rows if x[1] is not None and all(c is not None and math.isfinite(c) for c in x[1])]
    width = max(1, -(-len(usual[0][1]) // 16))
    x = np.zeros((len(usual), 16 * width), np.int64)
    for i, row in enumerate(usual):
        x[i, : len(row[1])] = [math.floor(256 * c) for c in row[1]]
    x = x.reshape(len(usual), 16, width)
    order = sorted(range(len(usual)), key=lambda i: (usual[i][0] is None, usual[i][0] or 0, usual[i][1]))[:64]
    books = x[order].swapaxes(0, 1).copy()
    far = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    for _ in range(2):
        code, new = far().argmin(2), books.copy()
        for p in range(16):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    new[p, e] = own.sum(0) // len(own)
        books = new
    code, error = far().argmin(2), far().min(2).sum(1)
    total = {}
    for row, e in zip(usual, error):
        total[row[2]] = total.get(row[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1)).encode()).hexdigest()
    return sorted([(row[0], "".join(f"{v:02x}" for v in c), int(e), total[row[2]], digest) for row, c, e in zip(usual, code, error)], key=str)


@pytest.mark.parametrize("dim, rows, labels", [(32, 300, 3), (16, 40, 40), (20, 100, 2)])
def test_codes_match_brute_force(spark, dim, rows, labels):
    r = random.Random(dim)
    data = [(i, [r.choice([-1.5, -0.25, 0.0, 0.001, 0.7, 2.0]) + 0.01 * (i % 7) for _ in range(dim)], None if i % 11 == 0 else i % labels) for i in range(1, rows)]
    data += [(5, data[4][1], 1)] * 30 + [(None, data[0][1], None), (2, [0.0] * dim, 0)]
    odd = [(900, None, 1), (901, [1.0] * (dim - 1) + [None], 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] * dim, 1)]
    frame = spark.createDataFrame([(*x, "a") for x in data + odd + [(904, [1.0], 1)]], "vec_id long, embedding array<double>, label int, code string").repartition(6)
    got = sorted((tuple(x) for x in vector_codes.compress(spark, frame).collect()), key=str)
    assert got == brute_codes(data)
    assert vector_codes.compress(spark, frame.limit(0)).count() == 0 and vector_codes.compress(spark, frame.filter("vec_id >= 900 AND vec_id < 904")).count() == 0


def test_large_components_are_refused():
    with pytest.raises(ValueError):
        vector_codes.whole(pa.array([[2.0**21]], pa.list_(pa.float64())))
