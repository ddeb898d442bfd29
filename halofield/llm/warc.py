"""WARC archives: writing with revisits and segments, reading back with segment reassembly.

Writing: one archive a task, each record its own gzip member. The block of a response is an HTTP
message with chunked transfer framing. Blocks over SEGMENT bytes become a first segment and
continuation records that name the first one's id, their number, and in the last the total length.
Of the rows with equal payloads (SHA-1), the one with the smallest page_id is the response; the
others are revisits that refer to it and carry headers only.

Reading: records come back one a row. Whole records decode where they are read; segmented ones are
grouped by the id of their origin, ordered by number, checked for gaps and for the total length, and
then decoded. The payload is what the chunked framing holds; its digest must be the header's.

Rules for unusual rows: a null html counts as empty; a row without page_id is always a response and
no revisit refers to it; rows that share the smallest page_id of a payload are all responses; broken
records (missing segment, wrong length, wrong digest) fail the read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

SEGMENT, CHUNK = 32_768, 8_192
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, refers_to long, record_id string, origin_id string, segment int, total long, payload_bytes long, payload_digest string, block binary"
PAYLOAD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = line + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[line + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0)


def target(url: str | None, page_id: int | None) -> str:
    return quote(url or f"urn:page:{page_id}", safe=":/?#[]@!$&'()*+,;=%~")


def records_of(page_id: int | None, url: str | None, payload: bytes, first: int | None, first_url: str | None, name: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of one page, or its segments, under ids made from name.

    first, first_url: page_id and address of the response that has the equal payload.
    """
    urn = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}')}>"
    who = {"WARC-Date": DATE, "WARC-Target-URI": target(url, page_id), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Page-ID": page_id}
    if page_id is not None and first is not None and first != page_id:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": urn(1), **who, "WARC-Profile": REVISIT, "WARC-Refers-To-Target-URI": target(first_url, first), "WARC-Refers-To-Date": DATE, "Refers-To-Page-ID": first, "Content-Type": "application/http;msgtype=response"}, block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, piece in enumerate(pieces, 1):
        headers = {"WARC-Type": "response" if n == 1 else "continuation", "WARC-Record-ID": urn(n), **who, "Content-Type": "application/http;msgtype=response" if n == 1 else None}
        if len(pieces) > 1:
            headers |= {"WARC-Segment-Number": n, "WARC-Segment-Origin-ID": urn(1) if n > 1 else None, "WARC-Segment-Total-Length": len(block) if n == len(pieces) else None}
        yield record(headers, piece)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) as archives; returns one row an archive (path, records).

    Only (digest, page_id) is grouped, with a partial minimum before the exchange, and only payloads
    that occur more than once are joined back, so a payload that fills a third of the table is one
    row on that side; the join splits the other side where it is skewed. Payloads of fewer than
    ``least`` bytes are never revisits.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, out, n = f"{root}/part-{task.partitionId():06d}.warc.gz", None, 0
        for batch in batches:
            out = out or store.open_output_stream(f"{path}.{task.taskAttemptId()}", compression=None)
            for page_id, url, html, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                for r in records_of(page_id, url, (html or "").encode(), first, first_url, f"{root}/{task.partitionId()}/{n}"):
                    out.write(r)
                n += 1
        if out is not None:
            out.close()
            store.move(f"{path}.{task.taskAttemptId()}", path)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    spark = pages.sparkSession
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    same = page.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    marked = page.join(same, "sha", "left").select("page_id", "url", "html", "first", "first_url")
    marked.mapInArrow(write, "path string, n_records long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("path string, n_records long").parquet(f"{folder}/manifest")


def read_records(archives: DataFrame, folder: str, segmented: bool) -> DataFrame:
    """The whole records of the archives, decoded, or the segments, each with its block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as stream:
                    for h, block in parse(stream):
                        if ("warc-segment-number" in h) != segmented:
                            continue
                        row = {"page_id": number(h, "page-id"), "record_type": h["warc-type"], "refers_to": number(h, "refers-to-page-id"), "record_id": h["warc-record-id"], "origin_id": h.get("warc-segment-origin-id"), "segment": number(h, "warc-segment-number"), "total": number(h, "warc-segment-total-length"), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:")}
                        if segmented:
                            row["block"] = block
                        else:
                            row |= checked(row, block)
                        rows.append(row)
                        held += len(block) if segmented else 200
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(read, RECORD)


def checked(row: dict, block: bytes) -> dict:
    """Length and digest of a record's payload. A revisit's come from its headers."""
    if row["record_type"] == "revisit":
        lengths = [line for line in block.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        return {"payload_bytes": int(lengths[0].split(b":")[1]), "payload_digest": row["payload_digest"]}
    payload = payload_of(block)
    if (found := digest(payload)) != row["payload_digest"]:
        raise ValueError(f"digest of {row['record_id']}: {found}")
    return {"payload_bytes": len(payload), "payload_digest": found}


def reassemble(segments: DataFrame) -> DataFrame:
    """Join the segments of each record, grouped by origin id, and decode the result."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces = row.pop("pieces")
                if [p["segment"] for p in pieces] != list(range(1, len(pieces) + 1)):
                    raise ValueError(f"segments missing or repeated in {row['record_id']}")
                block = b"".join(p["block"] for p in pieces)
                if row.pop("total") != len(block):
                    raise ValueError(f"wrong total length of {row['record_id']}")
                out.append({k: v for k, v in (row | checked(row, block)).items() if k != "record_id"})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    first = F.col("segment") == 1
    whole = segments.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        F.max(F.when(first, F.col("page_id"))).alias("page_id"), F.max(F.when(first, F.col("record_type"))).alias("record_type"), F.max("refers_to").alias("refers_to"),
        F.max("payload_digest").alias("payload_digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
    )
    return whole.mapInArrow(join, PAYLOAD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as archives into the shared folder and read them back."""
    folder = shared_dir(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, least)
    columns = [c.split()[0] for c in PAYLOAD.split(", ")]
    return read_records(archives, folder, segmented=False).select(columns).unionByName(reassemble(read_records(archives, folder, segmented=True)).select(columns))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
