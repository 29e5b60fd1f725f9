"""Web archives written as WARC files by Spark and read back, with segment reassembly.

Equal payloads are stored once: the page of the largest id is a response, the others are revisits of it.
Responses are framed as chunked HTTP messages; a block above ``segment_chars`` is cut into a first
record and continuation records.  Files are written by Spark's text writer (records are UTF-8, closed by CRLF
CRLF) with gzip, so they go to whatever storage Spark reaches and survive lost executors.

Reading parses each file by content lengths.  Continuation records are grouped by origin identifier,
ordered by segment number, checked against the total length, and the chunked framing is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

from .common import materialise, prepare

SEGMENT_CHARS = 32768
CHUNK_CHARS = 4096
FILE_RECORDS = 4096
DATE = "2025-01-01T00:00:00Z"
_CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n")


def chunked(text: str, chars: int = CHUNK_CHARS) -> str:
    """Chunked transfer framing; chunks end between characters."""
    parts = [text[k:k + chars] for k in range(0, len(text), chars)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """Payload of chunked framing; None if it is broken."""
    out, at = [], 0
    while m := _CHUNK_SIZE.match(body, at):
        size = int(m[1], 16)
        if size == 0:
            return b"".join(out)
        part = body[m.end():m.end() + size]
        at = m.end() + size + 2
        if len(part) < size or body[at - 2:at] != b"\r\n":
            return None
        out.append(part)
    return None


def _record(headers: list[tuple[str, str]], block: str) -> str:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block.encode())}"]) + "\r\n\r\n" + block


def _clean(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\r\n]+", " ", value)


def page_records(seq: int, page: str | None, url: str | None, html: str, digest: str, refers: str | None,
                 segment_chars: int = SEGMENT_CHARS) -> list[str]:
    """The WARC records of one page, without the closing CRLF CRLF."""
    rid = f"<urn:page:{'' if page is None else page}:{seq}>"
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", DATE),
            ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{refers}>")]
        return [_record(head, f"{http}Content-Length: {len(html.encode())}\r\n\r\n")]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n{chunked(html)}"
    if len(block) <= segment_chars:
        return [_record(head, block)]
    parts = [block[k:k + segment_chars] for k in range(0, len(block), segment_chars)]
    out = [_record([*head, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}{k}')}>"
        total = str(len(block.encode())) if k == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid),
                            ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", total)], part))
    return out


def parse_records(data: bytes):
    """(headers, block) of every record of a WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4


def http_payload(block: bytes, revisit: bool) -> tuple[int | None, bytes | None]:
    """(payload size, payload) of an HTTP message; a revisit has the size only."""
    head, _, body = block.partition(b"\r\n\r\n")
    if revisit:
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
        return (int(size[1]) if size else None), None
    if re.search(rb"(?i)\r\ntransfer-encoding: *chunked", head):
        body = dechunked(body)
    return (None if body is None else len(body)), body


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_pages(spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                min_bytes: int = 0, segment_chars: int = SEGMENT_CHARS, file_records: int = FILE_RECORDS) -> None:
    """Write the pages as WARC files under ``path``.  Of pages with equal payloads of at least ``min_bytes`` bytes the one of
    the largest id is a response (rows that repeat that id are too), the others are revisits.  Null html is an empty
    payload; a null id counts as smallest, and without any other id all are responses."""
    prepare(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    last = rows.groupBy("digest", "size").agg(F.max("page").alias("last"))
    typed = rows.join(last, ["digest", "size"]).select(
        F.monotonically_increasing_id().alias("seq"), F.col("page").cast("string").alias("page"), "url", "html", "digest",
        F.when((F.col("size") >= min_bytes) & ~F.coalesce(F.col("page") == F.col("last"), F.col("last").isNull()),
               F.col("last").cast("string")).alias("refers"))

    def build(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": [r for seq, page, url, html, digest, refers in pdf.itertuples(index=False)
                                          for r in page_records(seq, page, url, html, base64.b32encode(bytes.fromhex(digest)).decode(),
                                                                refers, segment_chars)]}, dtype=object)

    (typed.mapInPandas(build, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records)
     .option("compression", "gzip").text(path))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit record under ``path``: page (string), url, payload_bytes, payload_digest, record_type, refers_to
    (string), ok and, with ``with_payload``, the payload.

    ``ok`` is false where segments are missing, their length differs from the stated total, the framing is broken or the
    payload differs from its digest; payload_bytes is null then, as far as it cannot be told."""
    prepare(spark)

    def finished(h, block):
        revisit = h["WARC-Type"] == "revisit"
        size, payload = http_payload(block, revisit) if block is not None else (None, None)
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        ok = size is not None and (revisit or base32_sha1(payload) == digest)
        refers = h.get("WARC-Refers-To")
        return (h["WARC-Record-ID"], h["WARC-Record-ID"][10:].rpartition(":")[0] or None, h.get("WARC-Target-URI"), size, digest, h["WARC-Type"],
                refers and refers[10:-1], ok, payload if with_payload else None)

    names = ["origin", "page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok", "payload"]
    shape = ("origin string, page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
             "ok boolean, payload binary")

    def parse(batches):
        for pdf in batches:
            for data in pdf["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                whole, parts = [], []
                for h, block in parse_records(data):
                    if "WARC-Segment-Number" not in h:
                        whole.append(finished(h, block))
                    else:
                        k = int(h["WARC-Segment-Number"])
                        total = h.get("WARC-Segment-Total-Length")
                        said = "\r\n".join(f"{a}: {b}" for a, b in h.items()) if k == 1 else None
                        parts.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), k, total and int(total), said, block))
                yield pd.concat([pd.DataFrame(whole, columns=names).assign(k=None, total=None, said=None, block=None),
                                 pd.DataFrame(parts, columns=["origin", "k", "total", "said", "block"]).reindex(
                                     columns=[*names, "k", "total", "said", "block"])]).astype(
                    {"payload_bytes": "Int64", "k": "Int64", "total": "Int64", "ok": "boolean"})

    def assemble(batches):
        for pdf in batches:
            out = []
            for segments, said, total in zip(pdf["segments"], pdf["said"], pdf["total"]):
                if said is None:
                    continue  # continuations without their first record tell no page
                block = b"".join(s["block"] for s in segments)
                whole = [s["k"] for s in segments] == list(range(1, len(segments) + 1)) and len(block) == total
                out.append(finished(dict(x.split(": ", 1) for x in said.split("\r\n")), block if whole else None))
            yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    read = materialise(files.mapInPandas(parse, f"{shape}, k long, total long, said string, block binary"), "records")
    segmented = (read.where("k is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("k", "block"))).alias("segments"), F.max("said").alias("said"), F.max("total").alias("total"))
        .mapInPandas(assemble, shape))
    out = read.where("k is null").select(*names).unionByName(segmented).drop("origin")
    return out if with_payload else out.drop("payload")


def archive_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """Write ``pages`` as WARC files in the shared scratch folder and read them back: one row per page."""
    prepare(spark)
    path = scratch_path(spark, f"llm-warc-{uuid.uuid4().hex}")
    write_pages(spark, pages, path, id_col, **how)
    kind = pages.schema[id_col].dataType
    return (read_archives(spark, path).withColumn("page", F.col("page").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
            .withColumnRenamed("page", id_col))
