"""Range joins, span table functions and names in texts, against brute force."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed, spans
from docloom.operators import matching, range_joins, retrieval

SPAN = "id int, k string, start long, end long"


def spans_of(r, n, keys):
    out = [(i, r.choice(keys), at := r.randint(-20, 200), at + (r.choice([0, 1, 2, 5, 9]) if r.random() < 0.95 else 300)) for i in range(n)]
    return out + [(9001, "a", None, 5), (9002, "a", 5, None), (9003, None, 1, 5), (9004, "a", 9, 3)]


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_overlaps_equal_plain_inequality(spark, width):
    r = random.Random(3)
    a, b = spans_of(r, 150, ["a", "a", "a", "b"]), spans_of(r, 120, ["a", "b", "c"])
    frames = [spark.createDataFrame(x, SPAN).repartition(4) for x in (a, b)]
    got = sorted((x.left.id, x.right.id) for x in range_joins.overlaps(*frames, ["k"], width=width).collect())
    ok = lambda s: None not in s and s[2] <= s[3]
    assert got == sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert range_joins.overlaps(frames[0].limit(0), frames[1], ["k"]).count() == 0


@pytest.mark.parametrize("group_rows", [20_000, 5])
def test_close_in_time_equals_all_pairs(spark, group_rows):
    r = random.Random(4)
    day = datetime(2024, 3, 1)
    rows = lambda n: [(i, r.choice("aaab"), day + timedelta(seconds=r.choice([0, 60, 1800, 1801, r.randint(0, 30_000)]))) for i in range(n)] + [(800, "a", None), (801, None, day)]
    a, b = rows(120), rows(90)
    frames = [spark.createDataFrame(x, "id int, k string, ts timestamp_ntz").repartition(3) for x in (a, b)]
    got = sorted((x.left.id, x.right.id) for x in range_joins.close_in_time(*frames, ["k"], "ts", 1800, group_rows).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] and y[2] and abs(x[2] - y[2]) <= timedelta(minutes=30))


def test_a_hot_bucket_is_dealt_out(spark):
    rows = spark.range(400).select(F.col("id"), F.lit("a").alias("k"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    met = range_joins.close_in_time(rows, rows.limit(10), ["k"], "ts", 60, group_rows=50)
    assert met.count() == 4000


# --- Table functions ----------------------------------------------------------------------------------------------------

TEXTS = ["Ann Alder met Bob Birch. Éva Ödön and Mr. Cy\nCedar", "", None, "no names", "A B", "Ann Alder " * 3000]


def test_spans_cut_the_surface_out_again(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = spans.capitalised(rows, 1).collect()
    want = [(i, m.start(), m.start() + len(m[0].rstrip()), m[0].rstrip()) for i, t in enumerate(TEXTS) for m in re.finditer(fixed.PROPER_NOUN, t or "")]
    assert sorted((r.doc_id, r.start, r.end, r.surface) for r in got) == sorted(want)
    assert all(r.text[r.start : r.end] == r.surface for r in got)
    assert spans.capitalised(rows.limit(0)).count() == 0


def test_table_functions_in_sql(spark):
    spans.register(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").createOrReplaceTempView("texts")
    got = spark.sql(r"SELECT doc_id, s.start, s.surface FROM texts, LATERAL pattern_spans(text, 'B\\w+') AS s WHERE doc_id = 0 ORDER BY start").collect()
    assert [(r.start, r.surface) for r in got] == [(14, "Bob"), (18, "Birch")]
    assert spark.sql("SELECT count(*) AS n FROM texts, LATERAL capitalised_spans(text)").first().n == spans.capitalised(spark.table("texts"), 0).count()


def test_located_surfaces_take_places_once(spark):
    rows = spark.createDataFrame([(1, "Ann and ann and Ann", ["Ann", "Ann", "Ann", "Ann", " and ", None]), (2, None, ["x"]), (3, "x", None)], "id int, text string, surfaces array<string>")
    got = sorted((r.id, r.nth, r.start, r.end, r.note) for r in spans.located(rows, "surfaces").collect())
    assert got == [(1, 0, 0, 3, None), (1, 1, 16, 19, None), (1, 2, 8, 11, None), (1, 3, -1, -1, "unlocated"), (1, 4, 3, 8, None), (2, 0, -1, -1, "unlocated")]
    assert retrieval.locate("a", []) == []


def test_mentions_in_documents(spark):
    text = "From: Ann Alder\n\nBob Birch was here"
    rows = spark.createDataFrame([("c1", 7, text, 100, 100 + len("Bob Birch was here"))], "chunk_id string, doc_id int, text string, char_start int, char_end int")
    got = {r.surface.split("\n")[0]: (r.doc_start, r.doc_end, r.in_header) for r in spans.document_mentions(rows).collect()}
    assert got["Bob Birch"] == (100, 109, False) if "Bob Birch" in got else any(h for *_, h in got.values())


# --- Names in texts -----------------------------------------------------------------------------------------------------


def brute_match(text, names):
    """By a search for each name, longest first; a match that is bounded and not taken yet ends its name's search."""
    low, used, out = text.lower(), [False] * len(text.lower()), []
    for name in sorted(names, key=lambda n: (-len(n), n)):
        for m in re.finditer(re.escape(name), low):
            a, b = m.span()
            if any(used[a:b]) or (a and low[a - 1].isalnum()) or (b < len(low) and low[b].isalnum()):
                continue
            out.append((name, a, b))
            used[a:b] = [True] * (b - a)
            break
    return out


@pytest.mark.parametrize("max_chars", [10_000, 30])
def test_names_match_brute_force(spark, max_chars):
    r = random.Random(5)
    parts = ["anna", "bell", "a", "ring", "élan", "x-y"]
    names = sorted({" ".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(60)})
    names = [n for n in names if len(n) >= 4]
    texts = ["".join(r.choice([*parts, " ", " ", ", ", "S", "é"]) for _ in range(r.randint(0, 60))) for _ in range(120)] + ["", "bell " * 5000]
    asked = spark.createDataFrame([*enumerate(texts), (900, None)], "question_id int, text string").repartition(5)
    held = spark.createDataFrame([(n.title(), f"E{i}") for i, n in enumerate(names)] + [("Anna Bell", "Z"), ("abc", "short"), (None, "n")], "name string, entity_id string")
    got = matching.match_entities(asked, held, max_chars=max_chars).collect()
    ids = {n: f"E{i}" for i, n in enumerate(names)}
    ids["anna bell"] = min(ids.get("anna bell", "Z"), "Z")
    for i, text in enumerate(texts):
        mine = sorted((x.rank, x.name, x.start, x.end, x.entity_id) for x in got if x.question_id == i)
        assert mine == [(k + 1, n, a, b, ids[n]) for k, (n, a, b) in enumerate(brute_match(text, list(ids)))], text
    assert matching.match_entities(asked, held.limit(0)).count() == 0 == matching.match_entities(asked.limit(0), held).count()


def test_first_two_entities(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c"), (2, 1, "z")], "question_id int, rank int, entity_id string")
    assert [tuple(r) for r in matching.first_two(rows).collect()] == [(1, "a", "b")]
