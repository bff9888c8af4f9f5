import random

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.functions import profile
from docloom.plans import catalog
from docloom.operators import retrieval
from docloom.operators.numbering import numbered
from docloom.sources import loadfile
from docloom.streaming import ingest


def test_load_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("﻿þBates Beginþ\x14þEmail Fromþ\x14þPagesþ\x14þDate Sentþ\nþX_001þ\x14þ Ann þ\x14þ2þ\x14þ03/04/2012þ\nþX_003þ\x14þtwo\nlinesþ\x14þbadþ\x14þ99/99/2012þ\nþX_004þ\x14þþ\x14þ1þ\x14þþ\n", encoding="utf-8")
    (tmp_path / "a.opt").write_text("X_001,V,p1,Y,,,2\nX_002,V,p2,,,,\nX_003,V,p3,Y,,,1\n")
    (tmp_path / "TEXT").mkdir()
    (tmp_path / "TEXT" / "X_001.txt").write_bytes(b"\xef\xbb\xbfhello \xff")
    texts = loadfile.list_texts(spark, str(tmp_path / "TEXT"))
    rows = {r.doc_id: r for r in loadfile.manifest(loadfile.read_dat(spark, str(tmp_path / "a.dat")), loadfile.read_opt(spark, str(tmp_path / "a.opt")), texts).collect()}
    assert rows["X_001"].email_from == "Ann" and rows["X_003"].email_from == "two\nlines" and rows["X_004"].email_from is None
    assert (rows["X_001"].pages, rows["X_003"].pages) == (2, None) and rows["X_003"].date_sent is None and rows["X_001"].date_sent.day == 4
    assert (rows["X_001"].opt_pages, rows["X_001"].image_pages, rows["X_001"].has_text, rows["X_003"].has_text) == (2, 2, True, False)
    assert loadfile.read_texts(spark, str(tmp_path / "TEXT")).collect()[0].text == "hello �"


def test_profile_edges(spark):
    rows = profile.profile(spark.createDataFrame([(1, None), (2, ""), (3, "xkcd brrr the of and http://a.b c@d.ef HOUSE_OVERSIGHT_12345")], "doc_id long, text string"))
    r = {x.doc_id: x for x in rows.collect()}
    assert r[1].n_words is None and r[2].n_words == 0 and r[2].alpha_ratio == 0
    assert (r[3].n_words, r[3].n_bates_stamps, r[3].n_emails, r[3].n_urls) == (5, 1, 1, 1) and r[3].no_vowel_ratio == 0.4


def test_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(i, "t") for i in range(10)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    go = lambda: ingest.start_ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d).awaitTermination()
    go()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["src", "dst", "n_chunks_joint", "n_docs", "npmi"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(catalog.QUERIES[k](spark, "/root/testdata/sf0.001").columns for k in ("profile_metrics", "communicated_with", "vector_top_k"))


def test_sheets_index_and_pages(spark, tmp_path):
    (tmp_path / "a.csv").write_text('item,verdict\n1,"y, ""sure""\nindeed"\n2, \n')
    assert [(r.item, r.verdict) for r in loadfile.read_sheets(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'y, "sure"\nindeed'), ("2", None)]
    retrieval.save_index(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>"), str(tmp_path / "index"))
    assert [(r.id, r.v) for r in retrieval.load_index(spark, str(tmp_path / "index")).collect()] == [(1, [0.6, 0.8])]
    loadfile.write_html(spark.createDataFrame([("<b>&", None)], "a string, b string"), str(tmp_path / "page"))
    assert [r.value for r in spark.read.text(str(tmp_path / "page")).collect()] == ["<tr><td>&lt;b>&amp;</td><td></td></tr>"]


def test_numbers_follow_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    assert {r.x: r.n for r in numbered(rows, [F.col("x").desc()], "n").collect()} == {i: 499 - i for i in range(500)}
    assert numbered(rows.limit(0), [F.col("x")], "n").count() == 0


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_split_reading_equals_one_task(spark, tmp_path, line_end):
    """A file of many splits, with line ends and blanks inside cells, empty cells and a byte-order mark."""
    r = random.Random(8)
    names = ["Bates Begin", "Email From", "Body", "File Size"]
    cells = lambda i: [f"D_{i:06}", r.choice(["", "ann@x.org", " bob "]), line_end.join("w" * r.randint(0, 90) for _ in range(r.randint(0, 12))), r.choice(["", str(i)])]
    rows = [names] + [cells(i) for i in range(1500)]
    path = tmp_path / "a.dat"
    path.write_bytes(("﻿" + line_end.join("\x14".join(f"þ{c}þ" for c in row) for row in rows) + line_end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        split = loadfile.read_dat(spark, str(path))
        assert split.rdd.getNumPartitions() > 10
        whole = loadfile.read_dat(spark, str(path), whole=True)
        got, want = (sorted(tuple(x) for x in f.fillna("").collect()) for f in (split, whole))
        fold = lambda t: tuple(c.replace("\r\n", "\n") for c in t)
        assert split.columns == whole.columns == names and len(got) == 1500 and [fold(x) for x in got] == [fold(x) for x in want]
        two = loadfile.read_dat(spark, str(path), columns=["Email From", "File Size"])
        assert two.columns == ["Email From", "File Size"] and two.count() == 1500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_load_files_are_written_and_odd_records_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", None), (None, ""), ("c", " z ")], "k string, v string").repartition(2)
    loadfile.write_dat(rows, str(tmp_path / "out"))
    got = {(r.k, r.v) for r in loadfile.read_dat(spark, str(tmp_path / "out"), names=["k", "v"]).collect()}
    assert got == {("a", "x\ny"), ("b", None), (None, None), ("c", "z")}
    (tmp_path / "bad.dat").write_text("þaþ\x14þbþ\nþ1þ\x14þ2þ\nþ1þ\x14þ2þ\x14þ3þ\n")
    with pytest.raises(Exception, match="a record has 3 cells, not 2"):
        loadfile.read_dat(spark, str(tmp_path / "bad.dat")).collect()
    with pytest.raises(Exception, match="holds the qualifier"):
        loadfile.write_dat(spark.createDataFrame([("þ",)], "k string"), str(tmp_path / "bad"))
