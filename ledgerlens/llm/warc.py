"""WARC archives: writing, and normalising monolithic gzip streams.

A WARC file compressed as one gzip stream can only be read from its start.  The
normaliser inflates such a stream once, piece by piece, cuts it into records,
and writes every record as a gzip member of its own, next to a sidecar index of
member offsets, so that a reader can fetch any record by itself.

Writing: each task writes its rows as one or more archives in the folder given
(a URI that every executor can reach), rolled over at ``ROLL`` bytes.  Files get
the task attempt in their name and count only if the returned manifest lists
them, so a task that is run again leaves no doubled record.

Equal payloads: the row with the smallest page id is a ``response``, the others
are ``revisit`` records that refer to it and carry no payload.

Defined results: a null html is an empty payload; a null url leaves the target
out; rows with a null page id are all responses and never referred to; rows that
repeat the smallest page id are responses too; an empty table gives no archive
and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import raw, shuffle_parts, stored
from ledgerlens.session import scratch_path

#: Inflated bytes after which a new archive is begun.
ROLL = 64 << 20
CHUNK = 1 << 18
DATE = "2000-01-01T00:00:00Z"
_GZIP = 16 + zlib.MAX_WBITS
#: Fixed value: profile of revisits by equal payload (WARC 1.1, section 6.7.2).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """The bytes of one WARC record; a revisit keeps the HTTP head, which tells the full length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=";/?:@&=+$,-_.!~*'()#[]%"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def heading(data: bytes) -> dict[str, str]:
    """Header fields of a record, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode().split("\r\n")[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated bytes; holds one record and one chunk at a time."""
    held = bytearray()
    need = 0  # bytes of the record at the front of ``held``; 0: its heading is not yet complete
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(heading(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def inflated(stream) -> Iterator[bytes]:
    """Inflated chunks of a gzip file of one or many members."""
    gz = zlib.decompressobj(_GZIP)
    while data := stream.read(CHUNK):
        while data:
            out = gz.decompress(data, 4 * CHUNK)
            if out:
                yield out
            data = gz.unconsumed_tail
            if gz.eof:
                data, gz = gz.unused_data, zlib.decompressobj(_GZIP)
    if out := gz.flush():
        yield out


def _member(data: bytes) -> bytes:
    gz = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    return gz.compress(data) + gz.flush()


def _open(uri: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): the smallest page id with an equal payload, for the other pages."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.sha2("html", 256))
    first = rows.groupBy("same").agg(F.min("page_id").alias("first"))
    return rows.join(first, "same").select(
        "page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives, one gzip stream each; returns the manifest (path, records)."""
    def run(batches):
        task = TaskContext.get()
        name, part, out, gz, size, count, path = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, None, 0, 0, ""

        def close():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)),
                                                     batch.column(3).to_pylist(), strict=True):
                if out is None:
                    path = f"{folder}/{name}-{part:04d}.warc.gz"
                    fs, local = _open(path)
                    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out, gz, size, count, part = fs.open_output_stream(local, compression=None), zlib.compressobj(
                        6, zlib.DEFLATED, _GZIP), 0, 0, part + 1
                data = record(page_id, url, html, refers_to)
                out.write(gz.compress(data))
                size, count = size + len(data), count + 1
                if size >= roll:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``manifest`` (column path) with a gzip member per record.

    Returns the index (path, offset, length, record_id, type); each archive also
    gets it as a file beside it, ``.idx.json``, one line per record.
    """
    index = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                       ("type", pa.string())])

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{source.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                fs, local = _open(target)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                rows, offset = [], 0
                from_fs, from_path = _open(source)
                with from_fs.open_input_stream(from_path, compression=None) as stream, fs.open_output_stream(
                        local, compression=None) as out, fs.open_output_stream(f"{local}.idx.json") as side:
                    for data in records(inflated(stream)):
                        head = heading(data[: data.index(b"\r\n\r\n")])
                        member = _member(data)
                        out.write(member)
                        row = {"path": target, "offset": offset, "length": len(member), "record_id": head["warc-record-id"],
                               "type": head["warc-type"]}
                        side.write(json.dumps({k: v for k, v in row.items() if k != "path"}).encode() + b"\n")
                        rows.append(row)
                        offset += len(member)
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, index)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, index)

    parts = shuffle_parts(manifest.sparkSession)
    return manifest.select("path").repartition(parts, "path").mapInArrow(
        run, "path string, offset long, length long, record_id string, type string")


def read_members(index: DataFrame) -> DataFrame:
    """Read the indexed records, each by its own offset: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Length and digest of a response are those of the payload read; a wrong digest fails the task.
    """
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches):
        path, file = None, None
        for batch in batches:
            rows = []
            for source, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if source != path:
                    if file is not None:
                        file.close()
                    fs, local = _open(source)
                    path, file = source, fs.open_input_file(local)
                file.seek(offset)
                data = zlib.decompress(file.read(length), _GZIP)
                cut = data.index(b"\r\n\r\n")
                head, body = heading(data[:cut]), data[cut + 4: -4]
                inner = body.index(b"\r\n\r\n")
                said = head["warc-payload-digest"].removeprefix("sha1:")
                size, payload = int(heading(body[:inner])["content-length"]), None
                if head["warc-type"] == "response":
                    payload = body[inner + 4:]
                    if (len(payload), payload_digest(payload)) != (size, said):
                        raise ValueError(f"record at {source}:{offset} does not match its digest")
                rows.append({"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": size,
                             "payload_digest": said, "record_type": head["warc-type"],
                             "refers_to": number(head.get("warc-refers-to")),
                             "payload": None if payload is None else payload.decode()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)
        if file is not None:
            file.close()

    return index.select("path", "offset", "length").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read every record back by the index."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest = stored(write_monolithic(with_revisits(pages, **columns), f"{folder}/monolithic"), "warc-manifest")
    index = stored(normalise(manifest, f"{folder}/members"), "warc-index")
    return read_members(index)
