"""State of many participants under few keys."""

from datetime import datetime, timedelta

from test_streaming import LETTER, links_of, shape

from docloom.operators import edges
from docloom.streaming import threads


def test_few_keys_hold_many_participants(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(threads, "BUCKETS", 2)
    day = datetime(2012, 1, 1)
    rows = [(f"p{i % 7}", f"q{i % 5}", f"m{i:02}", f"d{i % 3}", None if i == 11 else day + timedelta(days=9 * (i % 13)), ["harvest plan", "the old barn"][i % 2]) for i in range(40)]
    sink = links_of(spark, tmp_path, "few", [rows[:20], rows[20:]])
    whole = spark.createDataFrame(rows, LETTER)
    got = shape(*threads.threads_of(spark, sink, whole))
    assert got == shape(*edges.threads(whole)) and got[0]
    state = spark.read.format("statestore").option("stateVarName", "runs").load(str(tmp_path / "few-state"))
    assert state.select("key").distinct().count() <= 2
