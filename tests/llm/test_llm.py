import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import additive_quant, hgb, html_extract, media, mixing, order_minhash, piece_fst, quality, suffix_dedup, toxicity, warc
from docloom.llm.components import components
from docloom.llm.common import Workspace
from docloom.llm.queries import ORACLE_SQL, QUERIES
from docloom.session import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size target taken root digest body rk spans mark ids exact y node a b bucket _score _row".split()


def docs(spark, rows, clash=False):
    out = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)
    for c in CLASH if clash else ():
        out = out.withColumn(c, F.lit(f"own {c}"))
    return out


def words(seed, n, vocabulary=500):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


ODD = [(1, None, "a"), (2, "", "a"), (3, " ".join(words(1, 30)), None), (3, " ".join(words(1, 30)), None), (None, "x y", "b"), (4, "!!! ???", "b"), (5, " ".join(words(2, 20_000)), "c"), (6, "one", "c"), (7, " ".join(words(1, 30)), "c")]


# --- 1 ------------------------------------------------------------------------------------------------------------------


def test_html_drops_furniture_and_decodes():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Oaks &amp; elms</h1><p>The  oak
    is a tree, and it grows slowly.<br>It is old.</p><p>Elms fell ill &#8212; many died of it.</p></article>
    <div class="comments"><h3>Comments</h3><div class=comment><p>I like this very much, thank you.</p></div></div><footer>&copy; someone</footer></body></html>"""
    assert html_extract.extract_pages([page], html_extract.model()) == ["Oaks & elms\nThe oak is a tree, and it grows slowly. It is old.\nElms fell ill — many died of it."]


def test_html_held_out_pages_and_decoding():
    model = html_extract.model()
    x, y, pages = html_extract.training_set(120, 77)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    at = 0
    for p in pages:
        kept = set(html_extract.decode(p, model.score(x[at : at + len(p.tag)])))
        at += len(p.tag)
        assert all(p.tag[v] == "#text" for v in kept)
    contradictory = html_extract.parse("<div><p>text</p></div>")
    p = np.array([0.9, 0.001, 0.6, 0.7])[: len(contradictory.tag)]
    assert html_extract.decode(contradictory, p) == []


def test_html_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain words"), (4, "u", "<p>a<p>b</i></div><b"), (5, "u", "<div>" * 3000 + "deep"), (None, "u", "<!-- x"), (6, "u", "<script>var a='<p>no</p>'</script>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == "" and all("no" != r.text for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_query_matches_the_article(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in QUERIES["op1_html_extract"](spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (9, "http://b", big), (4, None, big), (2, "u\r\nX: y", "small"), (3, "u", "small"), (5, "u", None), (5, "u", None), (9, "http://b", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, folder = warc.archive(spark, pages)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        want = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(want) and r.payload_digest == hashlib.sha1(want).hexdigest()
        assert r.payload == (bytearray(want) if r.record_type == "response" else None)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if want == big.encode() and r.page_id != 9 else ("response", None))
    some = index.filter("page_id = 2")
    assert [r.url for r in warc.read_records(some, folder).collect()] == ["uX: y"]
    empty, where = warc.archive(spark, pages.limit(0))
    assert warc.read_records(empty, where).count() == 0


def test_warc_members_are_gzip_and_damage_is_found():
    member = warc.encode_record(7, "http://x", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response")
    bad = gzip.compress(gzip.decompress(member).replace(b"\r\n\r\npayload", b"\r\n\r\nPAYLOAD"))
    with pytest.raises(ValueError):
        warc.decode_record(bad)


# --- 3 ------------------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bound_is_sound():
    r = random.Random(4)
    for _ in range(400):
        a = [r.randint(0, r.choice([3, 40, 900])) for _ in range(r.randint(1, 40))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.randint(0, 40)) if r.random() < 0.5 else b.pop(r.randrange(len(b))) if len(b) > 1 else None
        least, most = order_minhash.edit_bounds(np.array(a, np.uint32), np.array(b, np.uint32))
        assert least <= edit_distance(a, b) <= most or most > edit_distance(a, b) and least > order_minhash._limit(len(a), len(b)) and edit_distance(a, b) > order_minhash._limit(len(a), len(b))


def test_alignment_by_bit_strings():
    r = random.Random(5)
    for _ in range(600):
        a, b = ([r.randint(0, r.choice([2, 9])) for _ in range(r.randint(1, 30))] for _ in range(2))
        d, x, y = edit_distance(a, b), np.array(a), np.array(b)
        assert all(order_minhash.aligned(order_minhash._places(x), len(a), y, k) == (d <= k) for k in (d - 1, d, d + 1, 0, 40))


def test_classes_match_brute_force(spark):
    r, rows = random.Random(2), []
    for g in range(12):
        base = words(g, 60 + 10 * g)
        for k in range(r.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(k * 2):
                copy[r.randrange(len(copy))] = f"new{r.randrange(999)}"
            rows.append((len(rows), " ".join(copy), "s"))
    rows += [(100, rows[0][1].upper() + "!", "s"), (101, "short text", "s"), (102, None, "s"), (103, "", "s"), (None, rows[3][1], "s")]
    split = {i: order_minhash._WORD.findall((t or "").lower()) for i, t, _ in rows}
    want = {i: i for i in split}
    for _ in split:
        for i, a in split.items():
            for j, b in split.items():
                if a and b and (a == b or edit_distance(a, b) * 5 <= max(len(a), len(b))):
                    low = min((x for x in (want[i], want[j]) if x is not None), default=None)
                    want[i] = want[j] = low
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark, docs(spark, rows)).collect()}
    assert got == want
    kept = {r.doc_id for r in order_minhash.keep_one(spark, docs(spark, rows, True)).collect()}
    assert kept == {c for i, c in want.items() if c is not None}


def test_classes_without_an_id_of_their_own_stay_apart(spark):
    texts = [" ".join(words(900 + i, 60)) for i in range(6)]
    near = " ".join([*texts[0].split()[:-1], "other"])
    rows = [(None, t, "s") for t in (*texts[:3], near)] + [(7, t, "s") for t in texts[3:]]
    kept = sorted((r.doc_id or 0, r.text) for r in order_minhash.keep_one(spark, docs(spark, rows)).collect())
    assert [i for i, _ in kept] == [0, 0, 0, 7, 7, 7] and len({t for _, t in kept}) == 6
    assert {t for _, t in kept} >= set(texts[1:])


def test_near_copies_in_wide_buckets_are_found(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 50)
    licence, rows = words(1_000, 150), []
    for i in range(300):  # distinct documents with one licence, each with a copy that shares no other shingle
        own = words(2_000 + i, 100, 100_000)
        rows += [(2 * i, " ".join(licence + own), "s"), (2 * i + 1, " ".join(licence + [f"x{k}" if k % 5 == 2 else w for k, w in enumerate(own)]), "s")]
    hashes = order_minhash._Hashes()
    keys = [order_minhash.sketch(np.array([hashes[w] for w in text.split()], np.uint64)) for _, text, _ in rows]
    meet = [i for i in range(300) if (keys[2 * i] == keys[2 * i + 1]).any()]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark, docs(spark, rows)).collect()}
    assert len(meet) > 250 and got == {2 * i + k: 2 * i if k == 0 or i in meet else 2 * i + 1 for i in range(300) for k in (0, 1)}


def test_order_matters_to_the_sketch():
    a = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    moved = np.concatenate([a[200:], a[:200]])
    same = (order_minhash.sketch(a) == order_minhash.sketch(moved)).mean()
    assert (order_minhash.sketch(a) == order_minhash.sketch(a.copy())).all() and same < 0.6


def test_components(spark):
    work = Workspace(spark, "test")
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (80, 70), (90, 90)], "a long, b long")
    assert {r.node: r.root for r in components(work, links, "c").collect()} == {i: 0 for i in range(51)} | {90: 70, 80: 70, 70: 70}
    assert components(work, links.limit(0), "e").count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return piece_fst.Transducer(piece_fst.read_model(piece_fst.MODEL)), sentencepiece.SentencePieceProcessor(model_file=piece_fst.MODEL)


def test_pieces_equal_the_library(spark, pieces):
    ours, theirs = pieces
    r = random.Random(9)
    signs = " abehlothnrs  \n\t.,;éèñüß日本☃😀0123<>_-▁ABTh"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [" " * k + "a" for k in (1, 15, 16, 17, 40)]
    texts += [x.text for x in table(spark, SF, "documents").limit(100).collect()]
    for t in texts:
        assert ours.encode(t).tolist() == theirs.encode(t)
        assert ours.decode(theirs.encode(t)) == theirs.decode(theirs.encode(t))


def test_parts_met_before_are_looked_up_without_a_call(pieces, monkeypatch):
    """A part is swept once, arcs are taken as they are met, and a full store is emptied without a change of results."""
    transducer, library = pieces
    text = " ".join(words(8, 400)) + " qzxv-17, \U0001f600 ab\n"
    wanted = library.encode(text)
    swept = []
    sweep = transducer.shortest_path
    monkeypatch.setattr(transducer, "shortest_path", lambda part: swept.append(part) or sweep(part))
    monkeypatch.setattr(transducer, "_arcs", None)
    transducer.known.clear()
    assert transducer.encode(text).tolist() == wanted and len(swept) == len(set(swept)) > 0
    done = len(swept)
    assert transducer.encode(text).tolist() == wanted and len(swept) == done
    monkeypatch.setattr(piece_fst, "KEPT_PARTS", 3)
    transducer.known.clear()
    assert transducer.encode(text).tolist() == wanted


def test_unigram_sweep_takes_the_best_path():
    model = {"pieces": ["<unk>", "▁", "a", "b", "ab", "▁a", "ba"] + [f"<0x{i:02X}>" for i in range(256)], "scores": [0, -3, -4, -4, -2, -2.5, -9] + [0] * 256, "types": [2] + [1] * 6 + [6] * 256, "bpe": False, "prefix": True}
    t = piece_fst.Transducer(model)
    assert [model["pieces"][i] for i in t.encode("ab b")] == ["▁", "ab", "▁", "b"]
    assert t.decode(t.encode("abé").tolist()) == "abé"


def test_normaliser_equals_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(library.serialized_model_proto())
    spec = m.normalizer_spec
    model = {"pieces": ["<unk>", "a"], "scores": [0, -1], "types": [2, 1], "bpe": False, "prefix": spec.add_dummy_prefix, "shrink": spec.remove_extra_whitespaces, "map": spec.precompiled_charsmap}
    ours = piece_fst.Transducer(model)
    assert len(ours.mapped.rules) > 1000
    r = random.Random(6)
    signs = "aA1 ①ﬁＡｶﾞ½é\u0301e\u0301\u00a0\u200b\t\n㍿ℌ日ـ…"
    for t in ["".join(r.choice(signs) for _ in range(r.randint(0, 20))) for _ in range(2000)]:
        assert ours.normalise(t) == library.normalize(t), repr(t)


def test_encode_decode_tables(spark):
    rows = piece_fst.encode(docs(spark, ODD, True), check=True)
    assert rows.filter("NOT exact").count() == 0 and rows.count() == len(ODD)
    back = piece_fst.decode(rows.select("doc_id", "ids"))
    assert sorted(str(r.text) for r in back.collect()) == sorted((t or "") for _, t, _ in ODD)
    assert piece_fst.encode(docs(spark, [])).count() == 0


# --- 5 and 8 ------------------------------------------------------------------------------------------------------------


def test_trees_learn_and_are_deterministic():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    a, b = hgb.fit(x, y), hgb.fit(x, y)
    assert ((a.score(x) > 0.5) == y).mean() > 0.95 and (a.score(x) == b.score(x)).all()
    assert hgb.fit(np.zeros((0, 4)), []).score(x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("name,label,mod,out,cut", [("op5_quality", "quality", 3, 1, 0.5), ("op8_toxicity", "toxic", 4, 2, 0.3)])
def test_classifiers_on_held_out_rows(spark, name, label, mod, out, cut):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).collect()
    truth = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x and not y]
    assert sum(pairs) / len(pairs) > 0.75


def test_classifiers_on_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    some = docs(spark, ODD + [(i, " ".join(words(i, 30)) if i % 2 else "JUNK!! " * 9, "s") for i in range(60)], True)
    for got in (quality.classify(some, labels), toxicity.classify(spark, some, labels), quality.classify(some, labels.limit(0)), toxicity.classify(spark, some, labels.limit(0))):
        assert got.count() == len(ODD) + 60 and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.classify(some.limit(0), labels).count() == 0 and toxicity.classify(spark, some.limit(0), labels).count() == 0
    kept = quality.keep_good(some, labels)
    assert kept.columns == some.columns and 0 < kept.count() < some.count()


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_neighbours_reach_recall(spark):
    rows = QUERIES["op6_additive_quant"](spark, "/root/testdata/sf0.1").collect()
    e = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").toPandas()
    v = np.stack(e.embedding).astype(float)
    n = np.sqrt((v * v).sum(1))
    hit = total = 0
    for i in np.flatnonzero(e.vec_id % 50 == 0):
        s = (v * v[i]).sum(1) / (n * n[i])
        s[i] = -9
        want = [int(e.vec_id[j]) for j in np.lexsort([e.vec_id, -s])[:5]]
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == e.vec_id[i])
        hit, total = hit + len({g[1] for g in got} & set(want)), total + 5
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(g[2] - s[list(e.vec_id).index(g[1])]) < 1e-12 for g in got)
    assert hit / total >= 0.95


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (6, [1.0, 0.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in additive_quant.neighbours(spark, frame, lambda i: i % 50 == 0).collect())
    assert got == [(0, 1, 5), (0, 2, 6), (0, 3, 6), (0, 4, None), (0, 5, 50), (50, 1, 0), (50, 2, 5), (50, 3, 6), (50, 4, 6), (50, 5, None)]
    assert additive_quant.neighbours(spark, frame.limit(0), lambda i: i % 50 == 0).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------------


def fill(sizes, budget):
    """Clamp, share out the excess, again and again."""
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, left = {}, dict(weights)
    while True:
        rest = budget - sum(capped.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 2 * sizes[s]
            del left[s]


def test_targets_match_the_loop(spark):
    r = random.Random(1)
    for _ in range(4):
        sizes = {f"s{i}": r.choice([0, 3, 50, 1000, 9000]) for i in range(r.randint(2, 9))} | {None: 40}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = fill(sizes, 1.5 * sum(sizes.values()))
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, " ".join(words(i, 1 + i % 40)), f"s{i % 5 if i % 3 else 0}") for i in range(600)] + ODD
    got = mixing.mix(docs(spark, rows))
    again = mixing.mix(docs(spark, rows[::-1]))
    assert sorted(map(str, got.select("doc_id", "taken").collect())) == sorted(map(str, again.select("doc_id", "taken").collect()))
    taken, target = Counter(), {}
    for r in got.collect():
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 20_000 if s == "c" else abs(taken[s] - target[s]) <= 45 for s in target)
    assert mixing.mix(docs(spark, [])).count() == 0
    clash = docs(spark, rows, True)
    mixed = mixing.repeat_rows(clash)
    assert mixed.columns == clash.columns and mixed.filter("size <> 'own size'").count() == 0
    assert mixed.count() == got.agg(F.sum("repeats")).first()[0]


# --- 9 ------------------------------------------------------------------------------------------------------------------


def brute_removal(bodies, n=400):
    seen = defaultdict(list)
    for d, b in enumerate(bodies):
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]].append((d, i))
    gone = [np.zeros(len(b), bool) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + n] = True
    return [(len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()) for b, g in zip(bodies, gone)]


def test_removal_matches_brute_force(spark):
    r, base = random.Random(3), [" ".join(words(g, 250)) for g in range(5)]
    rows = []
    for i in range(40):
        text = ""
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            a = r.randint(0, len(b))
            text += r.choice(["", " ".join(words(100 + i, r.randint(1, 90)))]) + b[a : a + r.choice([100, 399, 400, 401, 600, 3000])]
        rows.append((i, text, "s"))
    rows += [(60, "ab" * 600, "s"), (61, "é" * 500, "s"), (62, None, "s"), (63, "", "s"), (64, rows[2][1], "s"), (64, rows[2][1], "s"), (None, rows[5][1], "s")]
    got = sorted(map(str, (tuple(x) for x in suffix_dedup.digests(spark, docs(spark, rows)).collect())))
    want = brute_removal([(t or "").encode() for _, t, _ in rows])
    assert got == sorted(str((i, *w)) for (i, _, _), w in zip(rows, want))
    left = suffix_dedup.remove(spark, docs(spark, rows, True))
    assert left.count() == len(rows) and left.filter("n_chars <> coalesce(length(text), 0)").count() == 0 and left.filter("rk <> 'own rk'").count() == 0
    assert suffix_dedup.digests(spark, docs(spark, [])).count() == 0


@pytest.mark.parametrize("length", [100, 400])
def test_removal_in_many_batches(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "BATCH_SUFFIXES", 8)
    r, base = random.Random(8), " ".join(words(3, 2000))
    rows = [(i, " ".join(words(50 + i, 60)) + base[(a := r.randrange(9000)) : a + r.choice([length - 1, length, 3 * length])], "s") for i in range(60)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(spark, docs(spark, rows), length).collect())
    assert got == [(i, *w) for (i, _, _), w in zip(rows, brute_removal([t.encode() for _, t, _ in rows], length))]


def test_more_batches_do_not_order_suffixes_again(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_SUFFIXES", 8)
    passes, add = [], suffix_dedup.SuffixFamily.add

    def counted(family, batch, *rest):
        passes.append(batch.count() + sum(family.array(x).count() for x in family.levels))
        return add(family, batch, *rest)

    monkeypatch.setattr(suffix_dedup.SuffixFamily, "add", counted)
    rows = [(i, " ".join(words(300 + i, 300)), "s") for i in range(40)]
    suffixes = sum(len(keys) for _, _, keys, _ in suffix_dedup.suffixes([t.encode() for _, t, _ in rows]))
    assert suffix_dedup.digests(spark, docs(spark, rows)).filter("n_removed > 0").count() == 0
    assert len(passes) > 3 and sum(passes) < 2 * suffixes


def test_family_keeps_ordered_levels(spark):
    folder, r = f"{Workspace(spark, 'test').path}/family", random.Random(2)
    make = lambda n: [bytes(r.choice(b"ab") for _ in range(9)) + bytes(suffix_dedup.K - 9) for _ in range(n)]
    seen, frame = set(), lambda rows: spark.createDataFrame([(bytearray(x),) for x in rows], "suffix binary")
    for k in range(6):
        batch = make(60)
        family = suffix_dedup.SuffixFamily(spark, folder)  # another object each time: the levels are in the folder
        met = {bytes(x.suffix) for x in family.add(frame(batch)).collect()}
        assert met == {x for x in batch if x in seen or batch.count(x) > 1}
        seen |= set(batch)
        sizes = [b - a + 1 for a, b in family.levels]
        assert sum(sizes) == k + 1 and sizes == sorted(set(sizes), reverse=True)
        for level in family.levels:
            rows = sorted((x.f, x.at, bytes(x.suffix)) for x in family.array(level).select("suffix", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).collect())
            assert [x for *_, x in rows] == sorted({x for *_, x in rows})
    assert suffix_dedup.shared_prefixes([b"a" * 64, b"a" * 63 + b"b", b"a" * 63 + b"b"]).tolist() == [0, 63, 64]


def test_only_runs_of_enough_words_go(spark):
    passage, short = " ".join(words(700, 60)), " ".join(words(701, 45, 10**12))
    rows = [(i, " ".join(words(800 + i, 40)) + " " + (passage if i < 2 else short) + " " + " ".join(words(900 + i, 40)), "s") for i in range(4)]
    left = {r.doc_id: r.text for r in suffix_dedup.remove(spark, docs(spark, rows), 100, 51).collect()}
    assert all(78 <= len(left[i].split()) <= 81 for i in (0, 1)) and all(left[i] == rows[i][1] for i in (2, 3))


def test_long_text_in_parts(monkeypatch):
    data = bytes(random.Random(1).randrange(97, 123) for _ in range(30_000))
    whole = [x for _, spots, keys, _ in suffix_dedup.suffixes([data]) for x in zip(spots[0].tolist(), keys)]
    monkeypatch.setattr(suffix_dedup, "_LONG", 7_000)
    parts = [x for _, spots, keys, _ in suffix_dedup.suffixes([data]) for x in zip(spots[0].tolist(), keys)]
    assert set(whole) == set(parts)


def test_runs_at_part_boundaries_are_whole(monkeypatch):
    data = np.random.default_rng(4).integers(97, 123, 30_000, np.uint8).tobytes()
    found = lambda: [x for _, spots, keys, blocks in suffix_dedup.suffixes([data]) for x in zip(*spots.tolist(), keys, blocks)]
    whole = found()
    for size in (7_000, 1_001):
        monkeypatch.setattr(suffix_dedup, "_LONG", size)
        assert found() == whole


def test_removal_in_a_text_of_several_parts(spark):
    data = np.random.default_rng(5).integers(97, 123, 2 * suffix_dedup._LONG + 90_000, np.uint8).tobytes().decode()
    alone, at = data[::-1], suffix_dedup._LONG
    rows = [(1, alone, "s"), (2, data, "s"), (3, "A" + data[at - 450 : at + 450] + "B", "s")]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(spark, docs(spark, rows)).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {1: (0, 0, sha(alone)), 2: (900, 1, sha(data[: at - 450] + data[at + 450 :])), 3: (900, 1, sha("AB"))}


# --- 10 -----------------------------------------------------------------------------------------------------------------


def test_media_copies_are_found(spark):
    pictures = [media.draw(i) for i in range(12)]
    rows = [(i, media.encode_png(p)) for i, p in enumerate(pictures)]
    rows += [(20, media.encode_png(pictures[0][8:88, 5:90])), (21, media.encode_png(np.clip(pictures[1] * 0.7 + 30, 0, 255))), (22, media.encode_png(np.rot90(pictures[2]))), (23, rows[3][1]), (24, None), (25, b"junk"), (26, b""), (27, media.encode_png(np.full((64, 64), 9.0))), (None, rows[4][1])]
    got = {r.media_id: r.class_id for r in media.classes(spark, spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert (got[20], got[21], got[22], got[23], got[None]) == (0, 1, 2, 3, 4)
    assert all(got[i] == i for i in (*range(12), 24, 25, 26, 27))
    assert media.classes(spark, spark.createDataFrame([], "media_id long, media binary")).count() == 0


def test_many_copies_of_one_picture(spark):
    """Hundreds of noisy copies crowd the band values; with small crowds and blocks every step is taken."""
    noise, base = np.random.default_rng(4), media.draw(0)
    copies = [np.clip(base * 0.9 + noise.normal(0, 2, base.shape), 0, 255) for _ in range(150)] + [base[i % 6 :, i // 6 :] for i in range(24)]
    others = [media.draw(i) for i in range(1, 31)]
    rows = [(i, media.encode_png(p)) for i, p in enumerate(copies + others)]
    frame = spark.createDataFrame(rows, "media_id long, media binary")
    got = {r.media_id: (r.class_id, r.class_size) for r in media.classes(spark, frame).collect()}
    assert all(got[i] == (0, 174) for i in range(174)) and all(got[i] == (i, 1) for i in range(174, 204))


def test_blocks_give_the_links_of_brute_force(spark, monkeypatch):
    """A value held by all images, without rounds: blocks alone find the classes of a comparison of all pairs."""
    monkeypatch.setattr(media, "CROWD", 1)
    monkeypatch.setattr(media, "ROUNDS", 0)
    monkeypatch.setattr(media, "BLOCK", 5)
    noise, pictures = np.random.default_rng(4), [media.draw(i % 9) for i in range(40)]
    pictures = [media.raster(media.encode_png(np.clip(p + noise.normal(0, 9, p.shape), 0, 255))) for p in pictures]
    found = [media.describe(p) for p in pictures]
    least = list(range(40))
    for _ in range(3):
        for i in range(40):
            for j in range(40):
                shared = np.intersect1d(media.band_keys(found[i][1]), media.band_keys(found[j][1]))
                if i != j and len(shared) >= media.MIN_VOTES and (media.consensus(*found[min(i, j)], *found[max(i, j)]) >= media.MIN_INLIERS):
                    least[i] = least[j] = min(least[i], least[j])
    rows = [(i, media.encode_png(p)) for i, p in enumerate(pictures)]
    got = {r.media_id: r.class_id for r in media.classes(spark, spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert [got[i] for i in range(40)] == least and len(set(least)) < 30


def test_crowded_values_are_stored_once(spark, monkeypatch):
    """Images with crowded values meet by blocks: their values are not written again, round after round."""
    written = Counter()
    write = Workspace.write

    def counted(work, frame, name):
        out = write(work, frame, name)
        written[name] = out.count() if "key" in out.columns else 0
        return out

    monkeypatch.setattr(Workspace, "write", counted)
    monkeypatch.setattr(media, "CROWD", 1)
    scenes = [media.draw(i) for i in range(20)]
    rows = [(i, media.encode_png(p)) for i, p in enumerate(scenes + [np.clip(p * 0.8 + 20, 0, 255) for p in scenes])]
    got = {r.media_id: r.class_id for r in media.classes(spark, spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert [got[i] for i in range(40)] == [i % 20 for i in range(40)]
    assert sum(written.values()) <= 2 * written["bands"]


def test_blocks_find_pictures_that_share_few_values(monkeypatch):
    """Two corners that agree are enough for a comparison, in blocks of any cut; links inside a class are left out."""
    pairs = [(media.draw(seed), media._resize(media.draw(seed), 1 / 0.6)) for seed in (1016, 1023, 1029)]
    found = [media.describe(np.rint(x).astype(np.float32)) for pair in pairs for x in pair]
    assert all(len(np.intersect1d(media.band_keys(found[i][1]), media.band_keys(found[i + 1][1]))) < media.MIN_VOTES for i in range(0, len(found), 2))
    names = [bytes([i]) for i in range(len(found))]
    whole = media.Block(names, names, *([x.tobytes() for x in column] for column in zip(*found)))
    wanted = {(names[i], names[i + 1]) for i in range(0, len(found), 2)}
    assert set(media.links_between(whole, whole)) == wanted
    monkeypatch.setattr(media, "_MEETINGS", 3)
    assert set(media.links_between(whole, whole)) == wanted
    one_class = media.Block(names, [b""] * len(names), *([x.tobytes() for x in column] for column in zip(*found)))
    assert media.links_between(one_class, one_class) == []


def test_large_images_resized_and_cropped():
    scene = lambda seed: np.block([[media.draw(seed + 4 * r + c) for c in range(4)] for r in range(4)])
    big = scene(0)
    whole = media.describe(big)
    assert len(whole[1]) > 100
    for part in (big[100:260, 150:310], media._resize(big, 2.0), media._resize(big, 2**0.5)):
        other = media.describe(part)
        assert len(np.intersect1d(media.band_keys(whole[1]), media.band_keys(other[1]))) >= media.MIN_VOTES
        assert media.consensus(*whole, *other) >= media.MIN_INLIERS
    unlike = media.describe(scene(50))
    assert media.consensus(*whole, *unlike) < media.MIN_INLIERS


def test_rasters():
    image = np.arange(48).reshape(6, 8)
    assert (media.raster(media.encode_png(image)) == image).all()
    pgm = b"P5 8 6 255\n" + image.astype(np.uint8).tobytes()
    assert (media.raster(pgm) == image).all() and media.raster(b"\x89PNG\r\n\x1a\nbroken") is None


# --- Pipeline and registry ----------------------------------------------------------------------------------------------


def test_registry():
    assert [int(k[2:].split("_")[0]) for k in sorted(QUERIES, key=lambda k: int(k[2:].split("_")[0]))] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages(spark):
    start = table(spark, SF, "documents").withColumn("size", F.lit("own"))
    now, counts = start, []
    work = Workspace(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES:
        now = work.write(stage(spark, now, SF), name)
        counts.append(now.count())
        if name != "sentencepiece":
            assert now.columns == start.columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in work.read("quality").collect()}
    clean = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in clean) / len(clean) > 0.9
    near = work.read("near_duplicates")
    assert near.count() == near.select("doc_id").distinct().count() < len(kept)
    assert counts[1] == counts[2] and counts[3] == counts[4] and now.filter("NOT exact").count() == 0
