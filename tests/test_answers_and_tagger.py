"""Cited answers, model payloads, gates, and the trained tagger."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest

from docloom.functions import fixed
from docloom.operators import answering, citations, edges, gates, payloads, tagger

ROW = "src string, dst string, message_key string, doc_id string, page int, subject string, sent_at timestamp_ntz"
DAY = datetime(2012, 3, 4)


def store_of(spark):
    rows = [("a", "b", f"m{i}", f"d{i}", i, "plan", DAY) for i in range(5)] + [("b", "a", "m9", "d0", None, "oak", datetime(2013, 1, 2)), ("b", "a", "m9", "d0", 0, "oak", datetime(2013, 1, 2))]
    rows += [("b", "c", "n1", "e1", None, None, None), ("a", "z", "z1", "f", 7, "", DAY), ("z", "c", "z2", None, 1, "x", DAY), ("q", "q", "s", "s", 1, "s", DAY)]
    return citations.evidence_store(spark.createDataFrame(rows, ROW).repartition(3))


def test_evidence_is_bounded_but_counted(spark):
    held = {(r.a, r.b): r for r in store_of(spark).collect()}
    assert set(held) == {("a", "b"), ("b", "c"), ("a", "z"), ("c", "z")}
    ab = held["a", "b"]
    assert (ab.weight, ab.facts.n_messages, ab.facts.n_docs, ab.facts.subject) == (5, 6, 5, "plan")
    assert [(d.doc_id, d.page) for d in ab.facts.docs] == [("d0", 0), ("d1", 1), ("d2", 2)]
    assert (held["b", "c"].facts.first_sent, held["c", "z"].facts.docs, held["c", "z"].facts.n_docs) == (None, None, 0)


def test_connections_are_cited(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "nobody"), (None, "a"), ("a", "b")], "a string, b string")
    got = {(r.a, r.b): (r.hops, r.via, r.text) for r in citations.connection_texts(store_of(spark), pairs).collect()}
    assert set(got) == {("a", "b"), ("b", "a"), ("a", "c"), ("a", "nobody")}
    assert got["a", "b"] == (1, None, "- a wrote with b (6 messages, 2012-03-04 to 2013-01-02, e.g. 'plan'; d0 p. 0, d1 p. 1, d2 p. 2 and 2 more)")
    assert got["b", "a"][2].startswith("- b wrote with a (6 messages")
    hops, via, text = got["a", "c"]
    assert (hops, via) == (2, "b") and text.split("\n")[1:] == ["- b wrote with c (1 message; e1)", "  => a reaches c through b; no message between them was found"]
    assert got["a", "nobody"][0] == 0 and "No connection between a and nobody" in got["a", "nobody"][2]


def test_questions_get_the_graph_with_sources(spark):
    names = spark.createDataFrame([("Ann Alder", "a"), ("Bob Birch", "b"), ("Zed Elm", "z"), ("No Edges", "n")], "name string, entity_id string")
    asked = spark.createDataFrame([(1, "Did ann alder know Bob Birch?"), (2, "Who is Zed Elm?"), (3, "And no edges?"), (4, "Nothing"), (5, None)], "question_id int, text string")
    got = {r.question_id: (r.n_entities, r.text) for r in citations.question_contexts(asked, names, store_of(spark)).collect()}
    assert got[1][0] == 2 and "a wrote with b" in got[1][1] and "d0 p. 0" in got[1][1]
    assert got[2][0] == 1 and got[2][1].split("\n") == ["- z wrote with a (1 message, 2012-03-04; f p. 7)", "- z wrote with c (1 message, 2012-03-04, e.g. 'x')"]
    assert got[3] == (1, "") and got[4] == got[5] == (0, "")
    hits = spark.createDataFrame([(1, "a passage", "p1", "p1")], "rank int, text string, page_start string, page_end string")
    out = answering.answer("Did ann alder know Bob Birch?", hits, lambda prompt: prompt.upper(), names, store_of(spark))
    assert "a wrote with b" in out["context"] and "a passage" in out["context"] and "BOB BIRCH?" in out["answer"]


# --- Payloads -----------------------------------------------------------------------------------------------------------

PAYLOAD = "chunk_id string, doc_id int, text string, char_start int, char_end int, payload string"


def test_payloads_become_mentions_or_failures(spark):
    text = "From: Ann\n\nAnn met Oak Ltd and ann"
    good = '{"entities": [{"surface": "Ann", "type": "person"}, {"surface": " Ann ", "type": "PERSON", "verdict": "added"}, "loose", null, 3, {"surface": "Oak Ltd", "type": "ORG", "verdict": "kept"}, {"surface": "elm", "type": "GPE"}, {"surface": "x", "type": "ORG"}, {"type": "ORG"}, {"surface": 5, "type": "ORG"}]}'
    body = len("Ann met Oak Ltd and ann")
    bad = {"c2": None, "c3": '{"entities": [', "c4": '{"entities": {}}', "c5": "[]", "c6": "7"}
    rows = [("c1", 1, text, 50, 50 + body, good)] + [(k, 2, text, 0, body, v) for k, v in bad.items()] + [("c7", 3, "t", 0, 1, '{"entities": []}')]
    frame = spark.createDataFrame(rows, PAYLOAD).repartition(3)
    got = sorted((r.nth, r.start, r.surface, r.type, r.doc_start, r.note) for r in payloads.mentions(frame).collect())
    assert got == [(0, 6, "Ann", "PERSON", -1, "in_prepended_header"), (1, 11, "Ann", "PERSON", 50, "added"), (2, 19, "Oak Ltd", "ORG", 58, "kept"), (3, -1, "elm", "GPE", -1, "unlocated")]
    assert {r.chunk_id: r.reason for r in payloads.failures(frame).collect()} == {"c2": "missing", "c3": "malformed", "c4": "no entities", "c5": "no entities", "c6": "no entities"}
    assert payloads.mentions(frame.limit(0)).count() == 0


# --- Gates --------------------------------------------------------------------------------------------------------------


def test_gates_count_in_one_pass(spark, tmp_path):
    rows = [("e1", True), ("e1", False), ("e2", None), (None, False), ("e3", False)]
    spark.createDataFrame(rows, "entity_id string, in_header boolean").write.parquet(str(tmp_path / "m"))
    held = gates.mention_gates(spark.read.parquet(str(tmp_path / "m")), spark.createDataFrame([("e2",), ("e2",)], "entity_id string"))
    assert held.rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(r.entity_id for r in held.rows.collect()) == ["e1", "e3"]
    assert {r.gate: (r.rows, r.kept, r.dropped) for r in held.counts(spark).collect()} == {"linked": (5, 4, 1), "body": (4, 3, 1), "clean": (3, 2, 1)}
    mail = spark.createDataFrame([("MIAMI", "DESK", None, " "), ("a@x.org", "DESK", None, None)], "source string, target string, subject string, sent_raw string")
    gate = gates.routing_gate(mail)
    assert gate.rows.count() == 1 == edges.drop_routing(mail).count() and gate.counts(spark).first().dropped == 1


# --- Tagger -------------------------------------------------------------------------------------------------------------


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(1)
    k = len(tagger.TAGS)
    for n in (0, 1, 2, 4):
        for _ in range(6):
            scores, follow = r.integers(-3, 4, (n, k)).astype(np.float32), r.integers(-2, 3, (k + 1, k)).astype(np.float32) + tagger.ALLOWED
            path = tagger.viterbi(scores, follow)
            worth = lambda p: sum(scores[i, t] + follow[p[i - 1] if i else k, t] for i, t in enumerate(p))
            assert len(path) == n and (n == 0 or worth(path) == pytest.approx(max(worth(p) for p in itertools.product(range(k), repeat=n))))


def test_no_inside_without_its_beginning():
    model = tagger.Tagger(np.random.default_rng(0).normal(size=(2**tagger.BITS, len(tagger.TAGS))).astype(np.float32), np.zeros((len(tagger.TAGS) + 1, len(tagger.TAGS)), np.float32))
    text = "Ann Alder went to Oak, and Bob stayed"
    held = tagger.tokens(text)
    before = "O"
    for tag in (tagger.TAGS[t] for t in model.path(tagger.features(text, held))):
        assert tag[0] != "I" or before[1:] == tag[1:]
        before = tag
    assert model.spans("") == []


SAID = ["Mr. {p} of {o} went to {g} by train.", "In {g} the board of {o} met {p} again.", "Dear {p}, the {o} office near {g} is shut.", "They said {p} left {o} for {g}.", "Nobody came, and nothing was said.", "{o} sued {p} in {g} last year."]


def made(r, n):
    part = lambda: "".join(r.choice(["ba", "de", "lo", "mi", "ra", "to", "ve"]) for _ in range(r.randint(2, 3))).title()
    out = []
    for _ in range(n):
        held = {"p": (f"{part()} {part()}", "PERSON"), "o": (f"{part()} {r.choice(['Group', 'Partners', 'Ltd'])}", "ORG"), "g": (part(), "GPE")}
        text, names = "", []
        for piece in r.choice(SAID).replace("{", "|").replace("}", "|").split("|"):
            if piece in held:
                names.append((len(text), len(text) + len(held[piece][0]), held[piece][1]))
            text += held[piece][0] if piece in held else piece
        out.append((text, names))
    return out


def test_names_not_seen_before_are_tagged():
    r = random.Random(4)
    model = tagger.fit(made(r, 250))
    score = {t: [0, 0, 0] for t in fixed.ENTITY_TYPES}
    for text, names in made(r, 150):
        got = set(model.spans(text))
        for t in fixed.ENTITY_TYPES:
            a, b = {x for x in got if x[2] == t}, {x for x in names if x[2] == t}
            score[t] = [score[t][0] + len(a & b), score[t][1] + len(a - b), score[t][2] + len(b - a)]
    for t, (tp, fp, fn) in score.items():
        assert 2 * tp / (2 * tp + fp + fn) > 0.95, (t, score[t])


def test_training_ignores_the_order_of_texts():
    rows = made(random.Random(6), 40)
    a, b = tagger.fit(rows), tagger.fit(rows[::-1])
    assert (a.weight == b.weight).all() and (a.follow == b.follow).all()


def test_marked_texts_train_and_tag(spark):
    r = random.Random(8)
    rows = made(r, 120)
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, text string")
    names = spark.createDataFrame(sorted({(t[a:b], k) for t, n in rows for a, b, k in n}), "name string, type string")
    marked = tagger.mark(texts, names)
    model = tagger.train(marked, limit=100)
    chunks = spark.createDataFrame([("c", 1, rows[0][0]), ("e", 2, "")], "chunk_id string, doc_id int, text string")
    got = [(m.start, m.end, m.type) for m in tagger.tag(chunks, model).collect()]
    assert got == [tuple(x) for x in rows[0][1]]
