"""Zip archives as a Spark data source: a partition per member, ranged reads.

The driver lists the archives and reads their central directories (a few KB at
the end of each file, many at once); a task opens one archive, seeks to its
member and inflates it as a stream, so no task holds an archive or a member.
"""

from __future__ import annotations

import csv
import io
import json
import sys
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlens.sources.documents import BEFORE, Cutter, Root

SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("row_no", pa.int64()), ("fields", pa.list_(pa.string())),
                    ("value", pa.string()), ("error", pa.string())])
#: Rows handed over at once, directories read at once, and bytes of a JSON member scanned at once.
AT_ONCE, DIRECTORIES, CHUNK = 5000, 32, 1 << 20
BLANKS = b" \t\r\n"


@dataclass
class Member(InputPartition):
    archive: str
    member: str | None = None
    error: str | None = None


def _open(uri: str):
    fs, local = FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    return fs.open_input_file(local)


def _archives(path: str) -> list[str]:
    fs, local = FileSystem.from_uri(path if ":" in path else f"file://{path}")
    prefix = path[: len(path) - len(local)] if path.endswith(local) else ""
    here: FileInfo = fs.get_file_info(local)
    found = [here] if here.type == FileType.File else fs.get_file_info(FileSelector(local, recursive=True))
    return [prefix + f.path for f in found if f.type == FileType.File and f.path.lower().endswith(".zip")]


def _members(uri: str) -> list[Member]:
    try:
        with _open(uri) as raw, zipfile.ZipFile(raw) as zf:
            return [Member(uri, i.filename) for i in zf.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX")
                    and PurePosixPath(i.filename).suffix.lower() in (".csv", ".json")]
    except (zipfile.BadZipFile, OSError, ValueError) as broken:
        return [Member(uri, None, str(broken))]


def _chunks(raw) -> Iterator[bytes]:
    """The bytes of a member, cut at commas."""
    held = b""
    while data := raw.read(CHUNK):
        at = data.rfind(b",") + 1
        if at:
            yield held + data[:at]
            held = data[at:]
        else:
            held += data
    if held:
        yield held


def _one_document(raw) -> tuple[bytes, bool, bool]:
    """First byte of a JSON member, whether it is one document (nothing follows the root), and whether its root holds a list of its own."""
    root, whole, lists, ended = b"", Root(), Cutter(2), False
    for chunk in _chunks(raw):
        if ended:
            if chunk.strip(BLANKS):
                return root, False, False
            continue
        if not root:
            root = chunk.lstrip(b"\xef\xbb\xbf" + BLANKS)[:1]
            if root not in (b"[", b"{"):
                return root, False, False
        end = whole.end(chunk)
        lists.feed(chunk if end is None else chunk[:end])
        lists.held = []
        if end is not None:
            ended = True
            if chunk[end:].strip(BLANKS):
                return root, False, False
    return root, ended, lists.state != BEFORE


def json_rows(opened) -> Iterator[str]:
    """The rows of a JSON member: one document, or else one value per line.  ``opened`` gives its bytes anew each time."""
    with opened() as raw:
        root, single, own_list = _one_document(raw)
    with opened() as raw:
        if single and (root == b"[" or own_list):
            cutter = Cutter(1 if root == b"[" else 2)
            for chunk in _chunks(raw):
                yield from (_row(x) for x in cutter.feed(chunk) if x.strip(BLANKS))
        elif single:
            yield _row(raw.read())
        else:
            yield from (_row(line) for line in raw if line.strip(BLANKS))


def _row(element: bytes) -> str:
    text = element.decode("utf-8", "replace").lstrip("﻿").strip().replace("\r", " ").replace("\n", " ")
    json.loads(text)  # raises ValueError
    return text if text.startswith("{") else f'{{"0":{text}}}'


class MemberReader(DataSourceReader):
    def __init__(self, path: str, sep: str):
        self.path, self.sep = path, sep

    def partitions(self) -> list[Member]:
        archives = _archives(self.path)
        with ThreadPoolExecutor(DIRECTORIES) as pool:
            return [m for found in pool.map(_members, archives) for m in found] or [Member("")]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(part):
            rows.append(row)
            if len(rows) == AT_ONCE:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _rows(self, part: Member) -> Iterator[tuple]:
        if part.member is None:
            if part.error is not None:
                yield part.archive, None, -1, None, None, part.error
            return
        name = PurePosixPath(part.member)
        try:
            with _open(part.archive) as file, zipfile.ZipFile(file) as zf:
                if name.suffix.lower() == ".csv":
                    csv.field_size_limit(sys.maxsize)
                    with zf.open(part.member) as raw, io.TextIOWrapper(raw, "utf-8", errors="replace", newline="") as text:
                        for i, fields in enumerate(csv.reader(text, delimiter=self.sep)):
                            if fields:
                                yield part.archive, name.name, i, fields, None, None
                else:
                    for i, row in enumerate(json_rows(lambda: zf.open(part.member))):
                        yield part.archive, name.name, i, None, row, None
        except (zipfile.BadZipFile, ValueError, csv.Error, OSError, NotImplementedError) as broken:
            yield part.archive, name.name, -1, None, None, str(broken)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").option("sep", ",").load(path)``: the records of all CSV and JSON members."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive STRING, member STRING, row_no BIGINT, fields ARRAY<STRING>, value STRING, error STRING"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options["path"], self.options.get("sep", ","))
