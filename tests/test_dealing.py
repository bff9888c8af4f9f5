"""Edges meet by pair once, and tasks grow in number with the rows, not in size."""

import re

from docloom.operators import edges
from docloom.session import tasks_for


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark.range(10)) == least
    assert tasks_for(spark.range(1000), 10) == max(least, 100)


def test_co_recipients_meet_once(spark):
    rows = spark.createDataFrame(
        [(1, "a", "d1", 0, True, "s"), (1, "b", "d2", 1, True, "t"), (1, "c", "d2", 2, False, "t"), (2, "a", " ", 0, False, None), (2, "b", "d3", 1, True, "s"), (3, "a", "d9", 0, True, "u")],
        "message_key int, dst string, doc_id string, block_index int, is_cc boolean, subject string",
    ).selectExpr("*", "timestamp'2001-01-01 00:00:00' + make_interval(0, 0, 0, message_key) AS sent_at")
    found = edges.co_recipients(rows, 5)
    assert not re.search(r"Exchange hashpartitioning\(src#\d+L?, dst#\d+L?, [a-z_]+#", _plan(found))  # documents and subjects of a pair shuffle no more
    got = {(r.src, r.dst): (r.weight, r.n_cc, r.n_docs, r.doc_ids, r.subjects, r.span_days) for r in found.collect()}
    assert got == {("a", "b"): (2, 1, 3, "d1; d2; d3", "s; t", 1), ("a", "c"): (1, 0, 2, "d1; d2", "t; s", 0), ("b", "c"): (1, 0, 2, "d1; d2", "t; s", 0)}


def test_communication_meets_once(spark):
    rows = spark.createDataFrame(
        [("a", "b", 1, " ", True, "s"), ("a", "b", 1, "d1", False, None), ("a", "b", 2, "d1", False, " "), ("a", "b", 3, None, True, "t"), ("b", "a", 4, "", False, "u"), ("a", "a", 5, "d", False, "u")],
        "src string, dst string, message_key int, doc_id string, is_cc boolean, subject string",
    ).selectExpr("*", "timestamp'2001-01-01 00:00:00' AS sent_at")
    found = edges.communicated_with(rows, 5)
    assert set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", _plan(found)))) == {"src, dst, 5"}
    got = {(r.src, r.dst): (r.weight, r.n_rows, r.n_docs, r.n_cc, r.doc_ids, r.subjects) for r in found.collect()}
    assert got == {("a", "b"): (3, 4, 2, 2, "d1", "s; t"), ("b", "a"): (1, 1, 1, 0, "", "u")}


def test_message_counts_deal_pairs(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("a", "b", 2), ("b", "a", None)], "src string, dst string, message_key int")
    found = edges.message_counts(rows, 7)
    assert "src, dst, 7" in re.sub(r"#\d+L?", "", _plan(found))
    assert [tuple(r) for r in found.collect()] == [("a", "b", 2)]


def test_wide_bins_store_few_copies(spark):
    from docloom.operators import range_joins

    spans = spark.range(1000).selectExpr("id", "1 AS doc", "id * 7 AS start", "id * 7 + 20 AS end")
    met = range_joins.overlaps(spans, spans, ["doc"])
    assert re.search(r"/ 80\D", _plan(met))  # bins of four mean spans, not of one
    assert met.count() == sum(1 for i in range(1000) for j in range(max(0, i - 2), min(1000, i + 3)))


def test_connections_of_equals_texts_of_the_whole_store(spark):
    from docloom.operators import citations

    rows = spark.createDataFrame([("a", "b", 1, "d1", 1, "s"), ("b", "a", 2, "d2", 1, "s"), ("b", "c", 3, "d1", 2, None), ("c", "x", 4, "d3", 1, "t"), ("a", "x", 5, "d3", 1, "t"), ("x", "a", 6, None, None, "t")], "src string, dst string, message_key int, doc_id string, page int, subject string").selectExpr("*", "timestamp'2001-01-01 00:00:00' AS sent_at")
    pairs = spark.createDataFrame([("b", "a"), ("c", "a"), ("a", "c"), ("b", "x"), ("q", "a"), ("a", None)], "a string, b string")
    whole = citations.connection_texts(citations.evidence_store(rows), pairs).collect()
    part = citations.connections_of(rows, pairs, 5)
    assert sorted(map(tuple, part.collect()), key=str) == sorted(map(tuple, whole), key=str) and len(whole) == 5
    assert {(r.a, r.b, r.via, r.hops) for r in whole} == {("b", "a", None, 1), ("c", "a", "b", 2), ("a", "c", "b", 2), ("b", "x", "a", 2), ("q", "a", None, 0)}


def test_usable_documents_profile_each_text_once(spark, tmp_path):
    from docloom.plans import catalog

    spark.createDataFrame([(1, "the and of to in is it that was for"), (2, "xx"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.usable_documents(spark, str(tmp_path))
    assert "regexp" not in "".join(line for line in _plan(found).splitlines() if "Filter" in line)
    assert [r.doc_id for r in found.collect()] == [1]
