"""WARC archives with revisit resolution (op4).

Headers (place in the files, id, digest, size) alone are shuffled by payload digest and joined to the original of
their payload: the record with the smallest id. The revisits found so are marked where they lie (``in_place``), so
no payload is ever shuffled. A second scan writes the original as a ``response`` with its payload, all others as
``revisit`` records that name it, each with fresh headers. Every task writes gzip members to its own archive in the
shared folder and commits it by rename. Reading parses the archives back.

Defined results: a null payload is an empty one; rows that share the smallest id and the payload are
all responses; payloads smaller than ``min_bytes`` are always responses; a null URL has no
target header; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import in_place
from folioflow.llm.common import bounded_batches, shared_dir
from folioflow.llm.store import ShardFile

_DATE = "2026-01-05T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes after which a task starts its next archive file.
ROLL = 16 << 20
_CHUNK = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def resolve(rows: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The revisits among :func:`in_place.placed` rows: (_file, _row, mark), the mark being the original's id."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    heads = rows.select(in_place.FILE, in_place.ROW, F.col(id_col).alias("_id"), F.unhex(F.sha1(body)).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"))
    first = heads.groupBy("_digest").agg(F.min("_id").alias("_first"), F.min("_bytes").alias("_bytes"))
    # Joined by digest and size: the grouped side is dealt anew, so that Spark may split a hot payload.
    joined = heads.join(first, ["_digest", "_bytes"])
    return joined.filter((F.col("_bytes") >= min_bytes) & (F.col("_id") > F.col("_first"))).select(in_place.FILE, in_place.ROW, F.col("_first").alias("mark"))


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def encode_record(page_id, url, payload: bytes, refers) -> bytes:
    kind = "response" if refers is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", _PROFILE)]
    return _member(head, _HTTP + (payload if refers is None else b""))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as deduplicated archives into ``folder``; returns (lazily) name, records and bytes of each file."""
    bounded_batches(pages.sparkSession)
    pages = in_place.readable(pages.select(id_col, url_col, payload_col))
    revisits = in_place.write_marks(resolve(in_place.placed(pages), id_col, payload_col, min_bytes), "revisits")
    rows = in_place.placed(pages).select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), in_place.FILE, in_place.ROW)

    def write(batches):
        part, n, out, count, marks = TaskContext.get().partitionId(), 0, None, 0, in_place.Marks(revisits)
        made = []
        for b in batches:
            found, first = marks.look_up(b[in_place.FILE], b[in_place.ROW])
            for page_id, url, text, again, refers in zip(b["page_id"], b["url"], b["payload"], found.tolist(), first.tolist(), strict=True):
                if out is None:
                    name = f"pages-{part:06d}-{n:04d}.warc.gz"
                    out, count, n = ShardFile(folder, name), 0, n + 1
                out.write(encode_record(page_id, url, text.encode(), refers if again else None))
                count += 1
                if out.size >= ROLL:
                    out.commit()
                    made.append((name, count, out.size))
                    out = None
        if out is not None:
            out.commit()
            made.append((name, count, out.size))
        yield pd.DataFrame(made, columns=["name", "records", "bytes"])

    return rows.mapInPandas(write, "name string, records long, bytes long")


def parse_records(data: bytes):
    """(headers, block) of each gzip member."""
    view, at, left = memoryview(data), 0, b""
    while at < len(view) or left:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not left:
                left, at = view[at : at + _CHUNK], at + _CHUNK
                if not len(left):
                    raise ValueError("an archive ends within a record")
            parts.append(z.decompress(left))
            left = z.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and stored_bytes of every record in ``folder``."""
    page = lambda urn: None if urn is None or urn == "<urn:page:None>" else int(urn[10:-1])

    def parse(batches):
        for b in batches:
            for data in b["content"]:
                got = []
                for f, block in parse_records(data):
                    stored = len(block.partition(b"\r\n\r\n")[2])
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    got.append((page(f["WARC-Record-ID"]), int(f["X-Payload-Length"]), digest, f["WARC-Type"], page(f.get("WARC-Refers-To")), stored))
                out = pd.DataFrame(got, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInPandas(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long")


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` into a fresh shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    if not write_archives(pages, folder, **columns).agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long")
    return read_archives(spark, folder)


#: Five hex digits (20 bits) make four base32 letters.
ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(d, CAST(5 * i + 1 AS INT), 5) AS INT)) AS v FROM o)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to,
  CASE WHEN page_id > first THEN 0 ELSE n END AS stored_bytes
FROM b
"""
