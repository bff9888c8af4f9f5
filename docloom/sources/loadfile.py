"""Production load files, text trees and tables."""

from __future__ import annotations

import re
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Load-file columns and their names here.
RENAMES = {
    "Bates Begin": "doc_id", "Bates End": "bates_end", "Attachment Begin": "attach_begin", "Attachment End": "attach_end", "Document Extension": "ext", "Email From": "email_from", "Email To": "email_to", "Email CC": "email_cc", "Email BCC": "email_bcc",
    "Email Subject/Title": "email_subject", "Date Sent": "date_sent", "Date Received": "date_received", "Date Created": "date_created", "Date Last Modified": "date_modified", "Original Filename": "filename", "File Size": "file_size", "Pages": "pages", "Text Link": "text_link", "Native Link": "native_link",
}


def trim_cells(df: DataFrame) -> DataFrame:
    """String cells without white space at the ends, blank ones null."""
    return df.select(*[F.nullif(F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", ""), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def snake(name: str) -> str:
    return re.sub(r"[ /]", "_", name.strip().lower())


# What parts cells, and what stands around each.
CELL, QUALIFIER = "\x14", "þ"
_BETWEEN = f"{QUALIFIER}{CELL}{QUALIFIER}"


def _records(spark: SparkSession, path: str, line_end: str) -> DataFrame:
    """value: one row a record. The end of a record is a qualifier, a line end and a qualifier, so that line ends inside cells
    are none; Spark's text source splits files there, however large."""
    return spark.read.text(path, lineSep=f"{QUALIFIER}{line_end}{QUALIFIER}")


def _cells() -> Column:
    """The cells of a record. Only a file's first record still has its first qualifier and only its last record the last one; a
    qualifier next to a separator belongs to an empty cell."""
    bare = F.regexp_replace("value", f"^(?:﻿{QUALIFIER}|{QUALIFIER}(?!{CELL}))|(?<!{CELL}){QUALIFIER}\\s*$", "")
    return F.split(bare, _BETWEEN)


def read_dat(spark: SparkSession, path: str, columns: list[str] | None = None, names: list[str] | None = None, whole: bool = False) -> DataFrame:
    """A delimited file with field separator U+0014 and qualifier U+00FE around every cell; cells may hold line ends.

    Files are read in splits by many tasks. Only the given columns are made, all by default. Without `names` the first record has
    them; with names, files have no such record and a folder of files is read. A record with another number of cells than names
    ends the job: files whose cells are not all qualified are read with `whole`, one task a file.
    """
    if whole:
        rows = spark.read.csv(path, sep=CELL, quote=QUALIFIER, header=names is None, multiLine=True, encoding="UTF-8")
        rows = rows.toDF(*names) if names else rows
        return trim_cells(rows.select(*[F.col(f"`{c}`") for c in columns or rows.columns]))
    head = spark.read.text(path, lineSep="\n").limit(1).collect()
    line_end = "\r\n" if head and head[0].value.endswith("\r") else "\n"  # a header record is one line
    records = _records(spark, path, line_end)
    first = records.limit(1).select(_cells().alias("cells")).collect()
    titles = names or (first[0].cells if first else [])
    rows = records.select(_cells().alias("cells"))
    if names is None:
        rows = rows.filter(F.col("cells") != F.array(*[F.lit(t) for t in titles]))  # the header
    size = F.size("cells")
    told = F.raise_error(F.format_string(f"a record has %d cells, not {len(titles)}", size))
    checked = rows.select(F.when(size == len(titles), F.col("cells")).otherwise(told.cast("array<string>")).alias("cells"))
    return trim_cells(checked.select(*[F.col("cells")[i].alias(t) for i, t in enumerate(titles) if columns is None or t in columns]))


def write_dat(rows: DataFrame, path: str) -> None:
    """A folder of files with a record a row and no header; cells are text, nulls empty. Qualifiers inside cells are refused."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
    line = F.concat(F.lit(QUALIFIER), F.concat_ws(_BETWEEN, *cells), F.lit(QUALIFIER))
    held = F.exists(F.array(*cells), lambda c: c.contains(QUALIFIER))
    rows.select(F.when(held, F.raise_error(F.lit("a cell holds the qualifier")).cast("string")).otherwise(line).alias("value")).write.mode("overwrite").text(path)


def read_opt(spark: SparkSession, path: str) -> DataFrame:
    """A headerless page list of seven columns; the page count is null where it is no number."""
    rows = spark.read.csv(path, schema="page_id string, volume string, image_path string, doc_break string, folder_break string, box_break string, page_count string")
    return trim_cells(rows).withColumn("page_count", F.expr("try_cast(page_count AS BIGINT)"))


def opt_documents(pages: DataFrame) -> DataFrame:
    """doc_id, opt_pages, image_pages: pages belong to the document whose break came last."""
    order = Window.partitionBy("volume").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.withColumn("doc_id", F.last(F.when(F.col("doc_break") == "Y", F.col("page_id")), ignorenulls=True).over(order))
    return marked.groupBy("doc_id").agg(F.max("page_count").alias("opt_pages"), F.count("*").alias("image_pages"))


def list_texts(spark: SparkSession, root: str) -> DataFrame:
    """doc_id (file stem), text_path, volume (folder), text_bytes of all .txt files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root).select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("doc_id"), F.col("path").alias("text_path"), F.element_at(parts, -2).alias("volume"), F.col("length").alias("text_bytes"))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, text: whole files, bad bytes replaced, a leading byte-order mark dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    return files.select(name.alias("doc_id"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("text"))


def manifest(dat: DataFrame, opt: DataFrame, texts: DataFrame) -> DataFrame:
    """Load-file rows with dates, counts, presence flags, page counts and text files."""
    rows = dat.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in dat.columns})
    rows = trim_cells(rows.toDF(*[snake(c) for c in rows.columns]))
    for c in [c for c in rows.columns if c.startswith("date_")]:
        rows = rows.withColumn(c, F.try_to_timestamp(F.col(c), F.lit("MM/dd/yyyy")))
    for c in [c for c in ("pages", "file_size") if c in rows.columns]:
        rows = rows.withColumn(c, F.expr(f"try_cast({c} AS BIGINT)"))
    rows = rows.join(opt_documents(opt), "doc_id", "left").join(texts, "doc_id", "left")
    there = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    rows = rows.withColumn("bates_seq", F.expr("try_cast(element_at(split(doc_id, '_'), -1) AS BIGINT)"))
    return rows.withColumn("has_text", there("text_path")).withColumn("has_native", there("native_link")).withColumn("is_email", there("email_from")).withColumn("is_attachment", F.coalesce(F.col("attach_begin") != F.col("doc_id"), F.lit(False)) if "attach_begin" in rows.columns else F.lit(False)).orderBy("doc_id")


def locate_production(root: str) -> dict[str, str | None]:
    """Paths of the first load files and of the text and native folders of a production on a local path."""
    base = Path(root)
    first = lambda pattern: next((str(p) for p in sorted((base / "DATA").glob(pattern))), None)
    folder = lambda name: str(base / name) if (base / name).is_dir() else None
    return {"dat": first("*.dat"), "opt": first("*.opt"), "text": folder("TEXT"), "natives": folder("NATIVES")}


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small list of records as a table."""
    rows = yaml.safe_load(Path(path).read_text())
    return spark.createDataFrame(rows if isinstance(rows, list) else rows[next(iter(rows))], schema)


def write_yaml(df: DataFrame, path: str, limit: int = 10_000) -> None:
    """A small table as a list of records; larger ones are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for one YAML file")
    Path(path).write_text(yaml.safe_dump([r.asDict(recursive=True) for r in rows], sort_keys=False, allow_unicode=True))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Adjudication sheets: CSV files with a header and quoted cells that may hold line ends; all columns are text, blanks null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) for c in rows.columns])


def write_html(rows: DataFrame, path: str) -> None:
    """A folder of HTML tables, one for each part of rows."""
    safe = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in rows.columns], F.lit("</tr>"))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
