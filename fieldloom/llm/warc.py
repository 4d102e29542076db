"""WARC archives, and the normaliser of monolithic gzip files.

A monolithic archive is one gzip stream over all its records, which can't be read from the middle. The normaliser
inflates such a stream once, rewrites each record as a gzip member of its own and writes a sidecar index with the offset
and length of each member; a reader then inflates just the member it wants.

Files lie in the shared folder. Each task attempt writes under names of its own, and only names that reached the
written manifest are read, so a task that is lost or repeated leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm.shared import fresh_path, staged

#: Bytes of records after which an archive is closed and the next one is begun.
ROLL = 64 << 20
_CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(page: int | None, url: str | None, body: bytes, digest: str, response: int | None) -> bytes:
    """The bytes of a WARC/1.1 record: a revisit without payload if ``response`` names the page it refers to.

    A null url is left out; control characters and blanks in one are percent-encoded, so no url can forge a header.
    """
    block = _HTTP + (body if response is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page} {url}')}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(body)}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if response is not None:
        head += [f"X-Refers-To-Page: {response}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and the block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time; a stream that ends inside a record is an error."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            fields = bytes(held[at:end]).lower().split(b"\r\ncontent-length: ", 1)
            stop = end + 8 + int(fields[1].split(b"\r\n", 1)[0])
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError("the archive is cut off inside a record")


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, in pieces of at most _CHUNK bytes however well they were packed. A
    stream that ends inside a member, its checksum included, is an error."""
    z, open_member = zlib.decompressobj(31), False
    while raw := stream.read(_CHUNK):
        more = True
        while more:
            out = z.decompress(raw, _CHUNK)
            open_member = True
            if out:
                yield out
            raw, more = z.unconsumed_tail, bool(z.unconsumed_tail) or len(out) == _CHUNK
            if z.eof:
                raw, open_member = z.unused_data, False
                z, more = zlib.decompressobj(31), bool(raw)
    if open_member:
        raise ValueError("the archive is cut off inside a gzip member")


def _open(path: str):
    fs, name = FileSystem.from_uri(path)
    return fs, name


def write_monolithic(df: DataFrame, folder: str) -> DataFrame:
    """(path, records) of gzip archives written from (page_id, url, body, response), one or more for each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        out = z = name = None
        size = n = 0

        def done() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

        for batch in batches:
            for page, url, body, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = fs.open_output_stream(f"{at}/{name}", compression=None), zlib.compressobj(3, zlib.DEFLATED, 31)
                body = (body or "").encode("utf-8", "replace")
                raw = record(page, url, body, payload_digest(body), response)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= ROLL:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return df.select("page_id", "url", "body", "response").mapInArrow(work, "path string, records long")


def normalise(archives: DataFrame) -> DataFrame:
    """(path, index_path, records): each archive rewritten with a member for each record, and its sidecar index."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _open(path)
                mark = uuid.uuid4().hex
                new, index = at.replace(".warc.gz", f"-{mark}.member.warc.gz"), at.replace(".warc.gz", f"-{mark}.index.jsonl")
                offset = n = 0
                with fs.open_input_stream(at, compression=None) as src, fs.open_output_stream(new, compression=None) as out, fs.open_output_stream(index, compression=None) as side:
                    for raw in split_records(inflate(src)):
                        z = zlib.compressobj(3, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        side.write(json.dumps({"offset": offset, "length": len(member), "id": parse(raw)[0]["warc-record-id"]}).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                base = path[: len(path) - len(at.rsplit("/", 1)[1])]
                yield pa.RecordBatch.from_pydict({"path": [base + new.rsplit("/", 1)[1]], "index_path": [base + index.rsplit("/", 1)[1]], "records": [n]})

    return archives.select("path").mapInArrow(work, "path string, index_path string, records long")


def read_members(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each inflated alone at the offset that the index gives."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _open(path)
                rows: list[tuple] = []
                with fs.open_input_stream(_open(index)[1], compression=None) as side:
                    entries = [json.loads(x) for x in side.read().splitlines()]
                with fs.open_input_file(at) as src:
                    for e in entries:
                        src.seek(e["offset"])
                        h, block = parse(zlib.decompress(src.read(e["length"]), 31))
                        kind, digest, size = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        if kind == "response":  # worked out anew from what was stored
                            body = block.partition(b"\r\n\r\n")[2]
                            digest, size = payload_digest(body), len(body)
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                        rows.append((page and int(page), size, digest, kind, refers and int(refers), h.get("warc-target-uri"), e["offset"], e["length"]))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "offset", "length"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names)

    return archives.select("path", "index_path").mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, offset long, length long")


def archive_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """Write, normalise and read back a record for each row; a null payload is empty.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the greatest key is the response and the
    others revisit it (of repeated rows with that very key, all are responses, as is a row with a null key). Only payloads
    that occur again are looked up, in a table that is broadcast while it has at most ``broadcast_rows`` rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", F.sha1(F.encode("body", "UTF-8")))
    again = rows.filter(F.octet_length("body") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("sha", "first")
    again = staged(again, "repeated")
    side = F.broadcast(again) if again.count() <= broadcast_rows else again
    refers = F.when(F.col("page_id") < F.col("first"), F.col("first"))
    ready = rows.join(side, "sha", "left").select("page_id", "url", "body", refers.alias("response"))
    folder = fresh_path(spark, "warc")
    written = staged(write_monolithic(ready, folder), "monolithic")
    n = max(1, written.count())
    normal = staged(normalise(written.repartition(n, "path")), "normalised")
    return read_members(normal.repartition(n, "path"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every page, written and read back; see ``archive_pages`` for columns and odd rows."""
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
