"""WARC archives: written whole, normalised to a gzip member a record with an offset index, read back.

Each task writes its records as one gzip stream; ``normalise`` inflates such a file once, start to end, writes
every record as a member of its own and a sidecar of (offset, length); readers then seek to members.  Files are
written under names that no other attempt uses, and only names that reach the manifest count, so a task that
runs again does no harm.  The folder may be any that pyarrow's file systems reach (file, hdfs, s3, ...).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import materialise, release, shared_dir, ship

#: Payloads of fewer bytes are never stored as revisits.
LEAST_SHARED = 100
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; payload None makes a revisit of refers_to, which keeps the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    at = data.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in data[:at].decode().split("\r\n")[1:])
    block = data[at + 4 : at + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
    name = lambda k: int(v) if (v := head[k][len("<urn:page:") : -1]) else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[cut + 4 :]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"]):
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    return {"page_id": name("WARC-Record-ID"), "url": head["WARC-Target-URI"], "payload": payload, "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": name("WARC-Refers-To") if "WARC-Refers-To" in head else None}


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, inflated once in pieces of CHUNK bytes at most."""
    inflate = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            yield inflate.decompress(raw, CHUNK)
            raw = inflate.unconsumed_tail
            if inflate.eof:
                raw = inflate.unused_data
                inflate = zlib.decompressobj(31)
        # what the decompressor holds back comes without further input
        while piece := inflate.decompress(b"", CHUNK):
            yield piece


def _records(stream) -> Iterator[bytes]:
    """The records of a gzip stream; a record is held whole, and no more than one and a piece."""
    held, seen, need = bytearray(), 0, -1
    for piece in _inflated(stream):
        held += piece
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    seen = len(held)
                    break
                size = next(int(x[15:]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            seen, need = 0, -1
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise(files: fs.FileSystem, source: str, target: str) -> list[tuple[int, int]]:
    """Rewrite the archive source as target with a gzip member a record, and target + ".idx" with each member's
    offset and length as text lines, which it returns.  The source is read once and may be one stream or many."""
    index, at = [], 0
    with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(target, compression=None) as out:
        for data in _records(stream):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(data) + z.flush()
            out.write(member)
            index.append((at, len(member)))
            at += len(member)
    with files.open_output_stream(f"{target}.idx", compression=None) as out:
        out.write("".join(f"{a} {n}\n" for a, n in index).encode())
    return index


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages under folder, normalise the archives, and return the offset index
    (path, offset, length), which is a table in the shared folder.

    The payload is html_col in UTF-8, null as empty.  Of records with equal payloads of LEAST_SHARED bytes or more
    that with the least id is a response and the others revisit it; rows that tie for the least id are all
    responses, as are rows of smaller payloads and rows of equal payloads that all lack an id.  A row without an id
    has an empty name.  Repeated rows give repeated records; no rows give no archive.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html").cast("long"))
    # payloads take part by their digests; only the digests that repeat are joined back
    first = rows.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("many")).where("many > 1").select(F.col("digest").alias("d"), "first")
    # payloads don't take part: the ids of a digest meet its first, and then each row its own result, by id and digest
    revisit = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull() & F.col("id").isNull())
    again = rows.where(F.col("n") >= LEAST_SHARED).select("id", "digest").join(first, F.col("digest") == F.col("d")).where(revisit)
    again = again.select(F.col("id").alias("i"), "d", "first").distinct()
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("first").isNotNull()
    rows = rows.select("id", "url", F.when(~revisit, F.col("html")).alias("html"), "n", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        z, out = zlib.compressobj(6, zlib.DEFLATED, 31), None
        for b in batches:
            for r in b.to_pylist():
                out = out or files.open_output_stream(f"{name}.whole", compression=None)
                payload = None if r["html"] is None else r["html"].encode()
                out.write(z.compress(record(r["id"], r["url"], payload, r["n"], r["digest"], r["refers_to"])))
        if out is None:
            return
        out.write(z.flush())
        out.close()
        index = normalise(files, f"{name}.whole", name)
        files.delete_file(f"{name}.whole")
        yield pa.record_batch([pa.array([name.rpartition("/")[2]] * len(index)), pa.array([a for a, _ in index], pa.int64()), pa.array([n for _, n in index], pa.int64())], ["path", "offset", "length"])

    out = materialise(rows.mapInArrow(write, "path string, offset long, length long"), "warc-index")
    release(spark)
    return out


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, read by seeking to their members: page_id, url, payload (null in revisits),
    payload_bytes, payload_digest, record_type and refers_to.  Every response's payload is checked by its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        path, stream = None, None
        for b in batches:
            for at in range(0, len(b), 500):
                found = []
                for r in b.slice(at, 500).to_pylist():
                    if r["path"] != path:
                        path, stream = r["path"], files.open_input_file(f"{base}/{r['path']}")
                    stream.seek(r["offset"])
                    found.append(parse(zlib.decompress(stream.read(r["length"]), 31)))
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return index.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of pages in the shared folder, read back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder)
