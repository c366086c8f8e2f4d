"""WARC archives and their capture index.

Writing: each row becomes one WARC/1.1 record, a gzip member of its own, in archives of bounded size. Rows of equal payloads
are told by digest and length; the one with the largest id is the response, the others are revisits that refer to it.
Which digests are shared, and which rows stay as responses, is kept in two sieves of fixed size: a row whose digest no other has is written
where it stands, and of the others only those that may be responses take their payload along to meet their group.
Each task names its own files and gives back the places of its records; only a finished task's places enter the index, so files of a lost one are never read.

Index: each capture's line is keyed by the address with its host reversed, then the id. Sorted lines are packed into
compressed blocks; the sparse directory of the blocks (first key, place) is sorted lines of the same form, and is packed again until at
most `MOST_TOP` are left: two levels up to two million captures, three up to a billion. A lookup walks down by binary search and a range
read for each block, then reads only the record's own bytes from the archive. Wanted keys come sorted, so a block is opened once in a task.

A null payload is empty (and equal to other empty ones); a null address is kept as such; null ids
are never the largest unless all are null, and then all are responses. Equal rows of the largest id are all responses.
Every row has its record, repeated ones too. Extra columns are ignored; an empty table gives no archive and an empty result.
A payload of any length is one record; batches of rows are bounded by `BATCH_BYTES` or by one row, archives by `ARCHIVE_BYTES` and one record.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.llm.common import stored
from rampwise.llm.exact import HOT, passing, sieve, sieve_of
from rampwise.session import pinned

ARCHIVE_BYTES, BATCH_BYTES, LINES_PER_BLOCK, LINES_PER_TASK, READS_PER_TASK, READ_BYTES, MOST_TOP = 256 << 20, 32 << 20, 512, 200_000, 5_000, 2 << 20, 4_096
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "key string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each 40 bits are eight digits."""
    sha = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _told(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Each row with digest, size and head: the id of its group's response, null where no other row has its payload. Of revisits html may be null."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html").cast("long")})
    group = F.when(F.col("size") >= least_bytes, F.xxhash64("digest", "size"))
    shared = sieve(p.select(group.alias("group")).where("group IS NOT NULL"), "group")
    p = passing(p, group, shared, "may_share")
    groups = pinned(p.where("may_share").groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n")))
    stays = sieve_of(groups.select(F.xxhash64("digest", "size", "head").alias("key")), "key")
    alone = p.where("NOT may_share").select("page_id", "url", "html", "digest", "size", F.lit(None).cast("long").alias("head"))
    # a group of nulls alone has a null head, and its rows are responses
    key = F.xxhash64("digest", "size", "page_id")
    met = passing(p.where("may_share"), key, stays, "may_stay").select("page_id", "url", F.when(F.col("may_stay"), F.col("html")).alias("html"), "digest", "size")
    total = groups.agg(F.sum("n")).first()[0] or 0
    named = groups.select(F.col("digest").alias("_digest"), F.col("size").alias("_size"), F.when(F.col("n") > 1, F.col("head")).alias("head"), "n")
    # fewer than HOT groups hold more than 1 / HOT of these rows each
    hot = named.where(F.col("n") * HOT > total).select("_digest", "_size", F.col("head").alias("hot_head"), F.lit(True).alias("_hot"))
    by_hot = met.join(F.broadcast(hot), (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left").drop("_digest", "_size")
    done = by_hot.where("_hot").select("page_id", "url", "html", "digest", "size", F.col("hot_head").alias("head"))
    cool = named.where(F.col("n") * HOT <= total).drop("n")
    rest = by_hot.where("_hot IS NULL").drop("_hot", "hot_head").join(cool, (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size"))).drop("_digest", "_size")
    return alone.unionByName(done).unionByName(rest)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url and, in `value`, the record of each page without the two line ends after it."""
    p = _told(pages, least_bytes)
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    safe = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), safe), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")), F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("head")))),
             F.when(again, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: application/http; msgtype=response"),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return p.select("page_id", safe.alias("url"), F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block).alias("value"))


class _Files:
    """Files of bounded size in a folder that executors share; each piece's place is given back."""

    def __init__(self, folder: str, label: str, most: int):
        self.folder, self.label, self.most, self.out, self.at, self.name = folder.rstrip("/"), label, most, None, 0, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        from pyarrow import fs

        if self.out is None or self.at and self.at + len(data) > self.most:
            self.close()
            self.name, self.at = f"{self.folder}/{self.label}-{uuid.uuid4().hex}", 0
            system, path = fs.FileSystem.from_uri(self.name)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out = system.open_output_stream(path)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(data) + packer.flush()


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives and returns the line of each record: key, file, offset, length."""
    most = ARCHIVE_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path, "archive", most)
        for batch in batches:
            ids, urls, values = (batch.column(c) for c in ("page_id", "url", "value"))
            yield _lines([(capture_key(u.as_py(), i.as_py()), *files.add(_gzip(v.as_py().encode() + b"\r\n\r\n"))) for i, u, v in zip(ids, urls, values)])
        files.close()

    spark = pages.sparkSession
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, str(BATCH_BYTES))
    try:
        return stored(records(pages, least_bytes).mapInArrow(write, LINE), "warc-lines")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def reversed_host(url: str | None) -> str:
    """com,example,www)/path?query of an address; its fragment is left out."""
    if url is None:
        return "-"
    url = re.sub(r"[\x00-\x20\x7f]", "%20", url)
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url
    return ",".join(reversed(m[1].lower().split("."))) + (m[2] or "") + ")" + (m[3] or "/")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{reversed_host(url)} " + ("-" if page_id is None else f"{page_id + 2**63:020d}")


def _head(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """A record's fields, where its block begins and where the record ends."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, end + 4, end + 4 + int(fields["Content-Length"]) + 4


def _page(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "none" else int(found)


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an open stream, one at a time."""
    at, data = 0, b""
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    if used:
                        raise ValueError(f"a record is cut off at {at}")
                    return
            parts.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        yield at, used, b"".join(parts)
        at += used


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of archives made elsewhere, read as streams: key, file, offset, length."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(name)
                rows = []
                with system.open_input_file(at) as stream:
                    for offset, length, data in members(stream):
                        fields, _, _ = _head(data, 0)
                        rows.append((capture_key(fields.get("WARC-Target-URI"), _page(fields["WARC-Record-ID"])), name, offset, length))
                        if len(rows) == 10_000:
                            yield _lines(rows)
                            rows = []
                yield _lines(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "archive-*").load(path).select("path").mapInArrow(parse, LINE)


def _packed(lines: DataFrame, path: str, n_lines: int) -> DataFrame:
    """Sorted lines in compressed blocks; the directory of the blocks, a line for each."""
    per_block, most = LINES_PER_BLOCK, ARCHIVE_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, made = _Files(path, "blocks", most), [], []

        def block():
            made.append((held[0][0], *files.add(zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode()))))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                if len(held) == per_block:
                    block()
                    held = []
            if made:
                yield _lines(made)
                made = []
        if held:
            block()
        files.close()
        if made:
            yield _lines(made)

    tasks = max(1, -(-n_lines // LINES_PER_TASK))
    return stored(lines.repartitionByRange(tasks, "key", "file", "offset").sortWithinPartitions("key", "file", "offset").mapInArrow(pack, LINE), "warc-directory")


def write_index(lines: DataFrame, path: str) -> DataFrame:
    """Writes blocks and directories and returns the top directory, of at most MOST_TOP lines (one level at least), with the number of levels below it and of all captures."""
    level, total = 0, lines.count()
    n = total
    while level == 0 or n > MOST_TOP:
        lines, level = _packed(lines, f"{path}/{level}", n), level + 1
        n = lines.count()
    return lines.withColumns({"levels": F.lit(level), "captures": F.lit(total)})


@functools.lru_cache(maxsize=4)
def _source(name: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name)
    return system.open_input_file(path)


def _walk(key: str, lines: list[tuple], levels: int, opened: Callable) -> Iterator[tuple]:
    """The lines of a key below a sorted directory; a key that begins a block may also end the ones before."""
    if levels == 0:
        for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]): bisect.bisect_right(lines, key, key=lambda x: x[0])]:
            yield line[1:]
        return
    for i in range(max(0, bisect.bisect_left(lines, key, key=lambda x: x[0]) - 1), bisect.bisect_right(lines, key, key=lambda x: x[0])):
        yield from _walk(key, opened(*lines[i][1:]), levels - 1, opened)


def find(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """file, offset and length of the captures whose key is in `wanted` (key): binary searches down the directories, a range read for each block."""
    top = sorted(tuple(r) for r in index.collect())  # at most MOST_TOP lines
    levels = top[0][4] if top else 0
    root = [t[:4] for t in top]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=8)
        def opened(file, offset, length):
            rows = (x.split("\t") for x in zlib.decompress(_source(file).read_at(length, offset)).decode().split("\n"))
            return [(k, f, int(o), int(n)) for k, f, o, n in rows]

        for batch in batches:
            found = [(k, *place) for k in batch.column("key").to_pylist() for place in _walk(k, root, levels, opened)]
            if found:
                yield _lines(found)

    keys = wanted.select("key").where("key IS NOT NULL").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return keys.mapInArrow(search, LINE).drop("key")


def read_records(places: DataFrame, keep_payload: bool = False, tasks: int = 1) -> DataFrame:
    """The records at these places, each read by its own range of bytes; the payload of a response is digested again.

    A place is small and its record isn't, so the number of tasks is the caller's and isn't left to the size of the places. Stretches
    of READ_BYTES are dealt by their hash, which takes no sample to the driver.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                data = zlib.decompress(_source(file).read_at(length, offset), 31)
                fields, start, end = _head(data, 0)
                payload = data[start: end - 4].split(b"\r\n\r\n", 1)[1]
                whole = fields["WARC-Type"] == "response"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                rows.append((_page(fields["WARC-Record-ID"]), len(payload) if whole else int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], refers, *([payload.decode()] if keep_payload else [])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + keep_payload]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return places.repartition(tasks, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(read, RECORD + (", payload string" if keep_payload else ""))


def keys_of(pages: DataFrame) -> DataFrame:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(re.sub(r"[\x00-\x20\x7f]", "%20", u) if u is not None else None, i) for u, i in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())], pa.string())], names=["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(key, "key string")


def archived(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes archives and index under `path` and reads the record of every page back through the index."""
    index = write_index(write_archives(pages, f"{path}/archives", least_bytes), f"{path}/index")
    top = index.first()
    return read_records(find(keys_of(pages), index), tasks=max(1, (top["captures"] if top else 0) // READS_PER_TASK))
