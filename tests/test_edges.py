import random
from datetime import datetime, timedelta

import pytest

from docloom.functions import dates
from docloom.operators import edges, resolution, similarity_join

LETTER = "src string, dst string, message_key string, doc_id string, block_index int, is_cc boolean, sent_at timestamp_ntz, subject string"


def letters(spark, rows):
    return spark.createDataFrame(rows, LETTER)


def test_weight_counts_distinct_messages(spark):
    day = datetime(2012, 1, 1, 23)
    rows = [("a", "b", "m1", f"d{i}", 0, False, day, "x") for i in range(3)] + [("a", "b", "m2", "d9", 0, True, day + timedelta(hours=2), "y"), ("a", "a", "m3", "d1", 0, False, day, "z")]
    (r,) = edges.communicated_with(letters(spark, rows)).collect()
    assert (r.weight, r.n_rows, r.n_docs, r.n_cc, r.span_days) == (2, 4, 4, 1, 0)


def test_evidence_is_cut_but_counted(spark):
    rows = [("a", "b", f"m{i}", f"d{i:02}", 0, False, None, None) for i in range(50)]
    (r,) = edges.communicated_with(letters(spark, rows)).collect()
    assert r.n_docs == 50 and r.doc_ids.endswith("; +30 more") and r.span_days is None


def test_co_recipients_over_copies(spark):
    rows = [("s", d, "m", doc, 0, cc, None, "x") for doc in ("d1", "d2", "d3") for d, cc in (("a", True), ("b", True), ("c", False))]
    got = {(r.src, r.dst): (r.weight, r.n_docs, r.n_cc) for r in edges.co_recipients(letters(spark, rows)).collect()}
    assert got == {("a", "b"): (1, 3, 1), ("a", "c"): (1, 3, 0), ("b", "c"): (1, 3, 0)}


def test_co_recipients_count_documents_of_partial_copies(spark):
    """A copy that names one recipient only is still a document of the message."""
    day = datetime(2012, 1, 1)
    rows = [("s", "a", "m", "d1", 0, False, day, "x"), ("s", "b", "m", "d1", 0, False, day, "x"), ("s", "c", "m", "d2", 0, False, day + timedelta(days=3), "z"), ("s", "a", "m2", "d3", 0, False, None, "y"), ("s", "b", "m2", "d3", 0, False, None, "y"), ("s", "c", "m3", "d9", 0, False, day, "w")]
    got = {(r.src, r.dst): r for r in edges.co_recipients(letters(spark, rows)).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    ab, ac = got["a", "b"], got["a", "c"]
    assert (ab.weight, ab.n_docs, ab.doc_ids, ab.subjects) == (2, 3, "d1; d2; d3", "x; y; z")
    assert (ac.weight, ac.n_docs, ac.doc_ids, ac.span_days) == (1, 2, "d1; d2", 3)


def test_co_recipients_move_once_and_hot_ones_are_dealt_out(spark, monkeypatch):
    """Rows move once by message and once by recipient; before, pairs moved three times, once for each kind of evidence."""
    r = random.Random(4)
    day = datetime(2012, 1, 1)
    rows = [("s", r.choice([*"abcd", "\x1e1\x1f", "zo\u00e9", None]), f"m{r.randrange(25)}", r.choice(["d1", "d2", "d\x1f3", " ", None]), i % 4, r.choice([True, True, False, None]), r.choice([None, day + timedelta(days=i % 9)]), r.choice([*"xyzw", None])) for i in range(250)]
    plan = edges.co_recipients(letters(spark, rows))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 2
    want: dict = {}
    best: dict = {}
    for _, dst, m, doc, *_ in rows:
        best.setdefault((m, dst), []).append(doc)
    for m in {m for m, _ in best}:
        docs = {x for k, v in best.items() if k[0] == m for x in v if x and x.strip()}
        names = sorted(d for k, d in best if k == m and d)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w = want.setdefault((a, b), [0, set()])
                w[0] += 1
                w[1] |= docs
    got = [tuple(x) for x in plan.collect()]
    assert {(x[0], x[1]): (x[4], x[5], x[10]) for x in got} == {k: (n, len(d), "; ".join(sorted(d))) for k, (n, d) in want.items()}
    monkeypatch.setattr(edges, "HOT", 3)
    again = edges.co_recipients(letters(spark, rows)).collect()
    assert sorted(repr(tuple(x)) for x in again) == sorted(repr(x) for x in got)


def test_header_and_noisy_mentions_make_no_edge(spark):
    schema = "chunk_id string, doc_id string, entity_id string, in_header boolean"
    rows = [(f"c{i}", f"D{i}", e, True) for i in range(5) for e in ("E1", "E2")]
    least = {"min_npmi": -1.0}
    assert edges.co_occurs_with(spark.createDataFrame(rows, schema), **least).count() == 0
    body = spark.createDataFrame([(c, d, e, False) for c, d, e, _ in rows], schema)
    (r,) = edges.co_occurs_with(body, **least).collect()
    assert (r.n_docs, r.doc_ids, r.weight) == (5, "D0; D1; D2; D3; D4", 1.0)
    assert edges.co_occurs_with(body, spark.createDataFrame([("E2",)], "entity_id string"), **least).count() == 0


def test_documents_are_counted_beyond_the_evidence(spark):
    rows = [(f"c{i}", f"D{i:03d}", e, False) for i in range(50) for e in ("E1", "E2")]
    (r,) = edges.co_occurs_with(spark.createDataFrame(rows, "chunk_id string, doc_id string, entity_id string, in_header boolean"), min_npmi=0.0).collect()
    assert r.n_docs == 50 and r.doc_ids.endswith("; +30 more")


def test_stacked_columns_keep_their_types(spark):
    a = spark.createDataFrame([("E1", "PERSON", "x")], "entity_id string, type string, canonical string")
    assert dict(edges.stack_nodes(a).dtypes) == {"entity_id": "string", "type": "string", "canonical": "string", "n_aliases": "bigint", "n_mentions": "bigint", "addresses": "array<string>"}
    assert dict(edges.stack_edges(spark.createDataFrame([("a", "b")], "src string, dst string")).dtypes)["first_sent"] == "timestamp"


def test_thread_window_and_generic_subjects(spark):
    day = datetime(2012, 1, 1)
    rows = [("a", "b", "m1", "d1", 0, False, day, "Re: harvest plan"), ("b", "a", "m2", "d2", 0, False, day + timedelta(days=30), "harvest plan"), ("a", "b", "m3", "d3", 0, False, day + timedelta(days=90), "FW: harvest plan"), ("a", "b", "m4", "d4", 0, False, day, "none"), ("a", "b", "m5", "d5", 0, False, day, "none")]
    nodes, links = edges.threads(letters(spark, rows))
    (n,) = nodes.collect()
    assert (n.entity_id, n.canonical, n.n_messages, n.n_participants) == ("THR_0000", "harvest plan", 2, 2)
    assert {(r.src, r.weight) for r in links.collect()} == {("a", 2), ("b", 2)}


def test_fractions_of_a_second_count_for_the_window(spark):
    day = datetime(2012, 1, 1)
    late = lambda micros: [("a", "b", "m1", "d", 0, False, day, "long topic"), ("a", "b", "m2", "d", 0, False, day + timedelta(days=60, microseconds=micros), "long topic")]
    assert [r.n_messages for r in edges.threads(letters(spark, late(0)), window_days=60)[0].collect()] == [2]
    assert edges.threads(letters(spark, late(1)), window_days=60)[0].collect() == []


def test_an_undated_message_joins_its_participants(spark):
    day = datetime(2012, 1, 1)
    rows = [("a", "b", "m1", "d", 0, False, day, "long topic"), ("a", "b", "m2", "d", 0, False, None, "long topic"), ("a", "b", "m3", "d", 0, False, day + timedelta(days=400), "long topic")]
    assert [r.n_messages for r in edges.threads(letters(spark, rows))[0].collect()] == [3]


def test_routing_rows_go(spark):
    rows = spark.createDataFrame([("MIAMI", "DESK", None, " "), ("a@x.org", "DESK", None, None), ("MIAMI", "DESK", "s", None)], "source string, target string, subject string, sent_raw string")
    assert edges.drop_routing(rows).count() == 2


def test_npmi_ranks_exclusive_pairs_first(spark):
    rows = [(f"c{i}", f"d{i % 9}", e) for i in range(125) for e in (["x", "y"] if i < 10 else ["p", "q"] if i < 60 else ["p", f"z{i}"])]
    got = {(r.src, r.dst): r.npmi for r in edges.co_occurs_with(spark.createDataFrame(rows, "chunk_id string, doc_id string, entity_id string"), min_npmi=-1.0).collect()}
    assert got["x", "y"] > got["p", "q"] and abs(got["x", "y"] - 1) < 1e-9
    same_doc = [(f"c{i}", "d", e) for i in range(9) for e in ("x", "y")]
    assert edges.co_occurs_with(spark.createDataFrame(same_doc, "chunk_id string, doc_id string, entity_id string"), min_npmi=-1.0).count() == 0


def test_noisy_names(spark):
    rows = spark.createDataFrame([("dear bob", "PERSON"), ("dear bob", "ORG"), ("a b c d e f g", "GPE"), (None, "PERSON")], "c string, t string")
    assert [r.n for r in rows.select(edges.is_noisy(rows.c, rows.t).alias("n")).collect()] == [True, False, True, False]


def test_dates(spark):
    rows = [("12/9/2016 3:46:19 PM",), ("Tuesday, November 22, 2016 2:15 PM",), ("15/10/2014 4:05 PM (GMT+02:00)",), ("no year 3/4",), ("",), (None,), ("3/4/2035",)]
    got = [r.sent_at for r in dates.parse_sent(spark.createDataFrame(rows, "sent_raw string").coalesce(1)).collect()]
    assert set(got) == {datetime(2016, 12, 9, 15, 46, 19), datetime(2016, 11, 22, 14, 15), datetime(2014, 10, 15, 16, 5), None} and got.count(None) == 4


def test_indel_ratio():
    assert similarity_join.indel_ratio("kitten", "sitting") == 200 * 4 / 13
    assert similarity_join.indel_ratio("", "") == 100 and similarity_join.indel_ratio("ab", "") == 0


def test_people_merge_by_initial_and_variant(spark):
    rows = spark.createDataFrame([(f"d{i}", n, "PERSON") for i, n in enumerate(["jeffrey birch", "jeffery birch", "j birch", "mark birch", "birch", "ann alder"])] + [("d0", "birch", "PERSON")], "doc_id string, norm string, type string")
    entities, aliases = resolution.resolve(rows)
    by = {r.norm: r.entity_id for r in aliases.collect()}
    assert by["jeffrey birch"] == by["jeffery birch"] == by["j birch"] == by["birch"]
    assert len({by["jeffrey birch"], by["mark birch"], by["ann alder"]}) == 3
    assert entities.count() == 3


def test_organisations_merge_only_when_close(spark):
    rows = spark.createDataFrame([("u s forest",), ("us forest",), ("oak company",), ("oak inc",), ("oakland",)], "norm string")
    roots = {r.norm: r.root for r in resolution.cluster_conservative(rows).collect()}
    assert roots["u s forest"] == roots["us forest"] and roots["oak company"] == roots["oak inc"] != roots["oakland"]


def test_actor_cascade(spark):
    actors = spark.createDataFrame([("a@x.org", []), ("bob birch", []), ("birch bob", []), ("c@x.org", ["bob birch"]), ("zed", [])], "key string, names array<string>")
    names = spark.createDataFrame([("bob birch", "PER_1")], "norm string, entity_id string")
    addresses = spark.createDataFrame([("a@x.org", "PER_2")], "address string, entity_id string")
    got = {r.key: (r.entity_id, r.method) for r in resolution.resolve_actors(actors, addresses, names).collect()}
    assert got == {"a@x.org": ("PER_2", "address"), "bob birch": ("PER_1", "exact"), "birch bob": ("PER_1", "reordered"), "c@x.org": ("PER_1", "display"), "zed": ("EML_000000", "minted")}


def edited(r, text, n):
    for _ in range(n):
        at = r.randint(0, len(text))
        text = text[:at] + r.choice("abcd") + text[at:] if r.random() < 0.5 else text[:at] + text[at + 1 :]
    return text


@pytest.mark.parametrize("threshold", [94, 88, 85, 75])
def test_similar_pairs_equal_all_pairs(spark, threshold):
    r = random.Random(threshold)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(0, 24))) for _ in range(60)] + ["a" * n for n in range(0, 30)] + ["ab" * n for n in range(8)] + [None]
    other = [None if t is None else edited(r, t, r.randint(0, 4)) for t in base for _ in range(2)]
    block = lambda t: None if t is None else len(t) % 2 if r.random() < 0.9 else None
    left, right = [(t, block(t)) for t in base], [(t, 0 if r.random() < 0.5 else 1) for t in other]
    frames = [spark.createDataFrame(x, "s string, k int").repartition(3) for x in (left, right)]
    got = similarity_join.similar_pairs(*frames, threshold=threshold, block=["k"]).collect()
    want = {(k, a, b) for a, k in left for b, j in right if None not in (a, b, k) and k == j and similarity_join.indel_ratio(a, b) >= threshold}
    assert len(got) == len(want) and {(x.k, x.a, x.b) for x in got} == want
    assert all(x.ratio == similarity_join.indel_ratio(x.a, x.b) for x in got)
    alone = similarity_join.similar_pairs(frames[1].select("s"), threshold=threshold).collect()
    texts = {t for t in other if t is not None}
    assert {(x.a, x.b) for x in alone} == {(a, b) for a in texts for b in texts if a < b and similarity_join.indel_ratio(a, b) >= threshold}


def test_crowded_blocks_in_cells_equal_all_pairs(spark, monkeypatch):
    """Names of few syllables, whose grams all are common, and long texts; before, they met by their grams alone."""
    monkeypatch.setattr(similarity_join, "CELL", 16)
    r = random.Random(5)
    name = lambda: "".join(r.choice(["ba", "de", "lo"]) for _ in range(r.randint(3, 7))) + " smith"
    left, right = ([("long " * 20 + name() if r.random() < 0.1 else name(), r.randrange(2)) for _ in range(150)] for _ in range(2))
    frames = [spark.createDataFrame(x, "s string, k int").repartition(3) for x in (left, right)]
    ratio = similarity_join.indel_ratio
    want = {(k, a, b, ratio(a, b)) for a, k in left for b, j in right if k == j and ratio(a, b) >= 88}
    for best in (False, True):
        plan = similarity_join.similar_pairs(*frames, threshold=88, block=["k"], best=best)
        got = {tuple(x) for x in plan.select("k", "a", "b", "ratio").collect()}
        assert got <= want and (best or got == want) and plan.filter("a <> b").count() > 100
        first = lambda rows: {(k, a): min((-x, b) for i, c, b, x in rows if (i, c) == (k, a)) for k, a, _, _ in rows}
        assert first(got) == first(want)
    alone = similarity_join.similar_pairs(frames[0], threshold=88, block=["k"])
    assert {tuple(x) for x in alone.select("k", "a", "b").collect()} == {(k, a, b) for a, k in left for b, j in left if k == j and a < b and ratio(a, b) >= 88}
    texts = sorted({x for x, _ in left}), sorted({x for x, _ in right})
    ia, ib, ratios = similarity_join.cell_pairs(*texts, 88, False, False)
    assert {(texts[0][i], texts[1][j], x) for i, j, x in zip(ia, ib, ratios)} == {(a, b, ratio(a, b)) for a in texts[0] for b in texts[1] if a != b and ratio(a, b) >= 88}


def test_best_partners_by_tries_equal_all_pairs(monkeypatch):
    """Names of few syllables with a common ending, letters beyond one plane, long and empty texts; walks are dealt out and bounded."""
    ratio, r = similarity_join.indel_ratio, random.Random(11)
    for threshold, syllables, ending in ((88, ["ba", "de", "lo", "ra"], " smith"), (75, list("abc"), ""), (94, ["ba", "é", "日本", "\U0001f600"], "x"), (88.5, ["ba", "de"], "")):
        monkeypatch.setattr(similarity_join, "FRONT", r.choice([8, 1 << 16]))
        a, b = (sorted({"".join(r.choice(syllables) for _ in range(r.randint(0, r.choice([5, 14, 60])))) + ending for _ in range(120)}) for _ in range(2))
        b = sorted({*b, *(x[:2] + "q" + x[2:] for x in a[::3])})
        want = {x: min((-ratio(x, y), y) for y in b) for x in a if x not in b}
        ia, ib, ratios = similarity_join.best_pairs(a, b, threshold)
        assert {a[i]: (-x, b[j]) for i, j, x in zip(ia, ib, ratios)} == {x: y for x, y in want.items() if -y[0] >= threshold}


def test_best_partners_take_far_fewer_steps_than_pairs(monkeypatch):
    """40,000 names of six syllables; before, every two names of a block met in some cell."""
    steps, walk = [], similarity_join._walk
    monkeypatch.setattr(similarity_join, "_walk", lambda *x: steps.append(walk(*x)) or steps[-1])
    syllables = "ba de lo mi ra to ve su ni ko".split()
    b = sorted("".join(syllables[int(c)] for c in str(100_000 + 7 * i)) + " smith" for i in range(40_000))
    a = sorted(x[:7] + "l" + x[8:] for x in b[::40])
    ia, ib, ratios = similarity_join.best_pairs(a, b, 88)
    assert len(ia) > 900 and all(x == similarity_join.indel_ratio(a[i], b[j]) for i, j, x in zip(ia, ib, ratios))
    assert sum(x[1] for x in steps) * 20 < len(a) * len(b)


def test_linked_addresses_compare_no_similar_names(spark, monkeypatch):
    """Exact and reordered names alone give addresses, so names are not compared for similarity."""
    seen = []
    whole = resolution.similar_pairs
    monkeypatch.setattr(resolution, "similar_pairs", lambda rows, *more, **how: seen.append(more) or whole(rows, *more, **how))
    rows = spark.createDataFrame([("maria lopez", "ml@x.org")] * 2 + [("lopez maria", "ml2@x.org")] * 2 + [("mario lopez", "no@x.org")] * 2, "norm string, address string")
    (r,) = resolution.link_addresses(rows, spark.createDataFrame([("maria lopez", "P1")], "norm string, entity_id string")).collect()
    assert (r.entity_id, r.addresses) == ("P1", ["ml2@x.org", "ml@x.org"]) and all(not more for more in seen)


def test_a_threshold_without_grams_is_refused():
    with pytest.raises(ValueError):
        similarity_join.gram_size(40)


def test_one_surname_of_many_names_is_no_quadratic_block(spark):
    """20,000 names of one last word against 500 misread ones; far fewer than all pairs meet."""
    from pyspark.sql import functions as F

    name = F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 14), F.lit(" smith"))
    people = spark.range(20_000).select(name.alias("norm"), F.col("id").cast("string").alias("entity_id"))
    seen = spark.range(500).select(F.regexp_replace(name, "^(.{5}).", "$1z").alias("norm"), F.col("id").cast("string").alias("want"))
    got = resolution.match_people(seen, people).join(seen, "norm")
    assert got.filter("how = 'fuzzy' AND entity_id = want").count() == 500


def test_people_and_addresses(spark):
    aliases = spark.createDataFrame([("reid oakman", "P1"), ("ann alder", "P2"), ("ann alder", "P0"), ("jeffrey birch", "P3"), ("jeffery birch", "P4"), (None, "P9")], "norm string, entity_id string")
    seen = [("reid oakman", "r@x.org")] * 2 + [("oakman reid", "w@x.org")] * 2 + [("ann alder", "once@x.org"), ("jeffrex birch", "j@x.org"), ("jeffrex birch", "j@x.org"), ("nobody here", "n@x.org"), (None, "z@x.org"), ("ann alder", None)]
    rows = spark.createDataFrame(seen, "norm string, address string")
    got = {r.norm: (r.entity_id, r.how) for r in resolution.match_people(rows, aliases).collect()}
    assert got == {"reid oakman": ("P1", "exact"), "oakman reid": ("P1", "reordered"), "ann alder": ("P0", "exact"), "jeffrex birch": ("P3", "fuzzy"), "nobody here": (None, "unmatched")}
    assert {r.entity_id: r.addresses for r in resolution.link_addresses(rows, aliases).collect()} == {"P1": ["r@x.org", "w@x.org"]}


def brute_people(forms, strict):
    near = lambda p, q: p == q or (not strict and (len(p) == 1 and q.startswith(p) or len(q) == 1 and p.startswith(q))) or similarity_join.indel_ratio(p, q) >= 88
    root = {f: f for f in forms if " " in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            x, y = a.split(), b.split()
            if a < b and x[-1] == y[-1] and (all(near(p, q) for p, q in zip(x[:-1], y[:-1])) or sorted(x) == sorted(y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {f: find(f) for f in root}


@pytest.mark.parametrize("strict", [False, True])
def test_people_clusters_equal_all_pairs(spark, strict):
    r = random.Random(9)
    given = ["jeffrey", "jeffery", "j", "john", "jon", "maria", "m", "marla", "ann", "anne", "x"]
    forms = sorted({" ".join([*r.sample(given, r.randint(1, 3)), r.choice(["birch", "oak", "elm"])]) for _ in range(120)} | {"solo"})
    got = {x.norm: x.root for x in resolution.cluster_people(spark.createDataFrame([(f,) for f in forms], "norm string"), strict).collect()}
    assert got == brute_people(forms, strict)
