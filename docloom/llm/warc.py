"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing. Each task appends gzip members, one per record, to archive files in the shared folder
and rolls to a new file at `roll_bytes`. For each record it returns an index row: file, offset,
length, url, digest. The index is a written table; a task that is run again writes files of its
own, and files that no index row names are never read. Large equal payloads are stored once: the
row with the largest page_id is a `response`, the others are `revisit` records that name it.

Reading. Selected index rows are dealt out by (file, block of offsets) and sorted; a task joins
neighbouring ranges into one read while the gap is small, and cuts the records out of it.

Defined cases: a null html is an empty payload; payloads under `min_revisit` bytes are always
responses; rows equal in payload and page_id are responses alike; a null page_id ranks below all
others; a null url is written as an empty target; very long payloads are records like others; other columns of pages
stay out; an empty table gives empty archives and results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Workspace

MIN_REVISIT = 1000
ROLL_BYTES = 64_000_000
READ_BYTES = 8_000_000
READ_GAP = 65_536
TASK_BYTES = 64_000_000
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_CRLF = b"\r\n"


def _open_fs(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _header(fields) -> bytes:
    return b"".join(f"{k}: {v}".encode() + _CRLF for k, v in fields)


def encode_record(page_id, url, payload: bytes, digest_hex: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP header, so also the payload's length."""
    revisit = refers_to is not None
    digest = "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return gzip.compress(b"WARC/1.1\r\n" + _header(fields) + _CRLF + block + _CRLF + _CRLF, compresslevel=1, mtime=0)


def decode_record(member: bytes) -> dict:
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(_CRLF) if x.lower().startswith(b"content-length:"))
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if kind == "response" and (len(payload) != told or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": told, "payload_digest": digest, "payload": payload if kind == "response" else None}


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to. Only repeated large payloads are counted and joined back."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= min_revisit)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("digest").alias("_d"), "_last")
    joined = rows.join(groups, (F.col("digest") == F.col("_d")) & (F.octet_length("payload") >= min_revisit), "left")
    is_revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "payload", "digest", F.when(is_revisit, F.col("_last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) to index rows; the files are there once a task ends."""

    def written(batches):
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        for b in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = encode_record(page_id, url, payload, digest, refers_to)
                out.write(member)
                index.append((name, at, len(member), url, digest, page_id, "response" if refers_to is None else "revisit"))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index), _INDEX_TYPES)] if index else [pa.array([], t) for t in _INDEX_TYPES], _INDEX_NAMES)
        if out is not None:
            out.close()

    return rows.mapInArrow(written, INDEX)


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
_RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def read_records(index: DataFrame, folder: str, with_payload: bool = True, read_bytes: int = READ_BYTES, gap: int = READ_GAP) -> DataFrame:
    """The records that the index rows name, by coalesced sorted reads.

    Tasks are counted by the bytes of the records and not by those of the index, of which one partition names gigabytes.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spare = min(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // read_bytes))
    tasks = max(1, spare, -(-total // TASK_BYTES))
    block = F.floor(F.col("offset") / read_bytes)
    ordered = index.select("file", "offset", "length", block.alias("_block")).repartition(tasks, "file", "_block").sortWithinPartitions("file", "offset")

    def runs(batches):
        now = None  # file, start, end, [(offset, length)]
        for b in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns[:3])):
                if now and now[0] == file and offset - now[2] <= gap and offset + length - now[1] <= read_bytes:
                    now[2] = max(now[2], offset + length)
                    now[3].append((offset, length))
                else:
                    if now:
                        yield now
                    now = [file, offset, offset + length, [(offset, length)]]
        if now:
            yield now

    def read(batches):
        fs, root = _open_fs(folder)
        for file, start, end, parts in runs(batches):
            with fs.open_input_file(f"{root}/{file}") as f:
                data = f.read_at(end - start, start)
            found = [decode_record(data[o - start : o - start + n]) for o, n in parts]
            if not with_payload:
                for r in found:
                    r["payload"] = None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(_RECORD_NAMES, _RECORD_TYPES)], _RECORD_NAMES)

    return ordered.mapInArrow(read, RECORD)


def archive(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, str]:
    """Write all pages; the index table and the folder of the archives."""
    work = Workspace(spark, "warc")
    folder = f"{work.path}/archives"
    return work.write(write_archives(with_revisits(pages), folder), "index"), folder


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
