"""Threads as a stream against threads as one batch."""

import random
from datetime import datetime, timedelta

from docloom.operators import edges
from docloom.streaming import threads

LETTER = "src string, dst string, message_key string, doc_id string, sent_at timestamp_ntz, subject string"


def links_of(spark, tmp, name, parts, **how):
    """The links after each part arrived, with a query of its own for each."""
    source, sink, checkpoint = (str(tmp / f"{name}-{x}") for x in ("in", "links", "state"))
    for part in parts:
        spark.createDataFrame(part, LETTER).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LETTER).parquet(source)
        query = threads.start_links(stream, sink, checkpoint, **how)
        query.awaitTermination()
        assert query.exception() is None
    return sink


def shape(nodes, links):
    return sorted((r.n_messages, r.n_participants, str(r.first_sent), str(r.last_sent), r.canonical) for r in nodes.collect()), sorted((r.src, r.weight, r.n_docs) for r in links.collect())


def test_three_triggers_equal_one_batch(spark, tmp_path):
    r = random.Random(6)
    day = datetime(2012, 1, 1)
    rows = []
    for i in range(90):
        sent = None if i % 31 == 7 else day + timedelta(days=r.choice([0, 3, 29, 30, 31, 60, 90, 200, r.randint(0, 700)]))
        rows.append((f"p{r.randint(0, 3)}", r.choice(["p0", "p4", None]), f"m{i:02}", f"d{i % 5}", sent, r.choice(["Re: harvest plan", "harvest plan", "the old barn", "none"])))
    rows.append(rows[3])
    r.shuffle(rows)
    whole = spark.createDataFrame(rows, LETTER)
    sink = links_of(spark, tmp_path, "a", [rows[:30], rows[30:60], rows[60:]])
    got = shape(*threads.threads_of(spark, sink, whole))
    assert got == shape(*edges.threads(whole)) and got[0]


def test_a_late_message_joins_two_threads(spark, tmp_path):
    day = datetime(2012, 1, 1)
    letter = lambda m, days: ("a", "b", m, "d", day + timedelta(days=days), "long topic")
    early, late = [letter("m1", 0), letter("m2", 5), letter("m3", 50), letter("m4", 52)], [letter("m5", 28)]
    first = links_of(spark, tmp_path, "b", [early])
    assert sorted(r.n_messages for r in threads.threads_of(spark, first, spark.createDataFrame(early, LETTER))[0].collect()) == [2, 2]
    both = links_of(spark, tmp_path, "c", [early, late], late="400 days")
    assert [r.n_messages for r in threads.threads_of(spark, both, spark.createDataFrame(early + late, LETTER))[0].collect()] == [5]


def test_runs():
    runs, linked = threads.take_in([(0, 10, "a"), (100, 110, "b")], "m", 55, 45)
    assert runs == [(0, 110, "a")] and linked == ["a", "b"]
    assert threads.take_in(runs, "n", 156, 45) == ([(0, 110, "a"), (156, 156, "n")], [])
    assert threads.take_in(runs, "u", None, 45) == ([(None, None, "u")], ["a"])
    assert threads.take_in([(None, None, "u")], "x", 5, 45) == ([(None, None, "u")], ["u"])
