"""Trace archives: tar files that hold many documents, planned as byte ranges.

A file for each aircraft and day is too small to plan by: listing and opening outweigh reading. An archive
holds thousands, and the source `trace_archive` cuts archives into ranges by their lengths alone, without
reading them on the driver. Headers of a tar file stand on multiples of 512 bytes and carry a checksum, so a task finds the
first one in its range by itself; a member belongs to the range in which its header begins, whoever
holds the rest of its bytes. Long names stand in headers of their own before the member's; a range therefore
starts to look `LOOK_BACK` bytes early.

Folders are opened through pyarrow's file systems: mounted folders, HDFS, S3, GCS. Files and folders whose names begin with
`_` or `.` aren't read. Archives that are compressed as a whole can't be cut and aren't taken; members are gzipped or plain.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rampwise.session import send_source
from rampwise.sources.traces import inflated, opened, parsed

FORMAT = "trace_archive"
BLOCK, LOOK_BACK, RANGE_BYTES, BATCH_BYTES = 512, 64 << 10, 64 << 20, 8 << 20
SCHEMA = pa.schema([("path", pa.string()), ("body", pa.string()), ("error", pa.string())])


@dataclass
class ByteRange(InputPartition):
    path: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def _header(block: bytes) -> tarfile.TarInfo | None:
    if len(block) < BLOCK or block[257:262] != b"ustar":
        return None
    try:
        return tarfile.TarInfo.frombuf(block, "utf-8", "replace")
    except tarfile.HeaderError:
        return None


def _long_name(kind: bytes, data: bytes) -> str | None:
    """The name that a header of its own gives the next member."""
    if kind == tarfile.GNUTYPE_LONGNAME:
        return data.split(b"\0", 1)[0].decode("utf-8", "replace")
    while data:
        length, _, _ = data.partition(b" ")
        if not length.isdigit() or not 0 < int(length) <= len(data):
            return None
        key, _, value = data[len(length) + 1:int(length) - 1].partition(b"=")
        if key == b"path":
            return value.decode("utf-8", "replace")
        data = data[int(length):]
    return None


def members(file: io.BufferedIOBase, low: int, high: int) -> Iterator[tuple[str, bytes | None]]:
    """(name, bytes) of the files whose header begins from `low` to before `high`; bytes are null where the archive ends early."""
    at, name = max(0, (low - LOOK_BACK) // BLOCK * BLOCK), None
    while at < high:
        file.seek(at)
        block = file.read(BLOCK)
        if len(block) < BLOCK:
            return
        info = _header(block)
        if info is None:  # between headers of a cut or damaged archive, or its closing blocks
            at, name = at + BLOCK, None
            continue
        after = at + BLOCK + -(-info.size // BLOCK) * BLOCK
        if info.type in (tarfile.XHDTYPE, tarfile.GNUTYPE_LONGNAME):
            name = _long_name(info.type, file.read(info.size)) or name
        else:
            if info.isreg() and at >= low:
                data = file.read(info.size)
                yield name or info.name, data if len(data) == info.size else None
            name = name if info.type == tarfile.XGLTYPE else None
        at = after


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        if self.step < 1:
            raise ValueError("rangeBytes must be positive")

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        hidden = lambda p: any(x[:1] in "_." for x in posixpath.relpath(p, root).split("/"))
        found = [info] if info.is_file else [i for i in system.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if i.is_file and not hidden(i.path)]
        ranges = [ByteRange(i.path, low, min(low + self.step, i.size)) for i in sorted(found, key=lambda i: i.path) for low in range(0, i.size, self.step)]
        return ranges or [ByteRange(root, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if part.low == part.high:
            return
        system, _ = opened(self.path)
        rows, held = [], 0
        with system.open_input_file(part.path) as raw, io.BufferedReader(raw, 1 << 20) as file:
            for name, data in members(file, part.low, part.high):
                body, error = (None, "truncated") if data is None else inflated(data)
                rows.append({"path": f"{part.path}#{name}", "body": body, "error": error})
                held += len(body or "")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


class ArchiveWriter(DataSourceArrowWriter):
    """One archive a task, under a hidden name until all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("archives are added to a folder, never replaced")
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        name, tar, stream = f"{uuid.uuid4().hex}.tar", None, None
        for batch in batches:
            for row in batch.select(["name", "body"]).to_pylist():
                if tar is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(f"{root}/_{name}")
                    tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.PAX_FORMAT)
                data = gzip.compress((row["body"] or "").encode(), mtime=0)
                entry = tarfile.TarInfo(row["name"])
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
        if tar is None:
            return Written(None)
        tar.close()
        stream.close()
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{root}/_{m.name}", f"{root}/{m.name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{root}/_{m.name}")


class TraceArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    send_source(spark).dataSource.register(TraceArchives)
    return spark


def scan_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, doc, error) of every document in an archive or a folder of archives; path is archive#member.

    A member that can't be inflated or parsed, or that the archive cuts short, has a null doc and says why.
    """
    return parsed(_registered(spark).read.format(FORMAT).option("rangeBytes", range_bytes).load(path))


def write_archives(docs: DataFrame, path: str, name: str = "name", body: str = "body") -> str:
    """Adds an archive for each task that has documents; a null body is kept as an empty document, a null name is refused.

    None of a job's archives can be seen before all of its tasks are done.
    """
    _registered(docs.sparkSession)
    named = F.coalesce(F.col(name).cast("string"), F.raise_error(F.lit("a document has no name")).cast("string"))
    docs.select(named.alias("name"), F.col(body).alias("body")).write.format(FORMAT).mode("append").save(path)
    return path
