"""Position traces: one JSON document per file, gzipped or not, whatever its name."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.session import send_source

GZIP_MAGIC = b"\x1f\x8b"
#: Folders that written documents are dealt to.
FOLDERS = 256


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def inflated(raw: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a document's bytes, gzipped or not."""
    try:
        data = gzip.decompress(raw) if raw[:2] == GZIP_MAGIC else bytes(raw)
        return data.decode("utf-8"), None
    except (OSError, EOFError, zlib.error, UnicodeDecodeError) as problem:
        return None, type(problem).__name__


def _inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # The text reader picks a codec by file extension; these files carry none.
    for batch in batches:
        found = [inflated(raw) for raw in batch["content"]]
        yield pd.DataFrame({"path": batch["path"], "body": [x[0] for x in found], "error": [x[1] for x in found]})


def write_traces(docs: DataFrame, path: str, name: str = "name", body: str = "body") -> str:
    """A gzipped file without extension for each document, `doc=<name>`, dealt to FOLDERS folders by its name; a null body is an empty document.

    Tasks write their files in place, so nothing is moved file by file on the driver; a task that runs again replaces its own files.
    """
    send_source(docs.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = opened(path)
        made: set[str] = set()
        for batch in batches:
            for folder, own, text in zip(batch["folder"], batch["name"], batch["body"]):
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{root}/{folder}/doc={quote(own, safe='')}") as file:
                    file.write(gzip.compress((text or "").encode(), mtime=0))
            yield pd.DataFrame({"n": [len(batch)]})

    named = F.coalesce(F.col(name).cast("string"), F.lit("null"))
    folder = F.format_string("part=%03d", F.pmod(F.xxhash64(named), F.lit(FOLDERS)))
    rows = docs.select(folder.alias("folder"), named.alias("name"), F.col(body).alias("body"))
    system, root = opened(path)
    system.create_dir(root, recursive=True)
    rows.repartition(FOLDERS, "folder").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


def scan_traces(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, doc, error): a document that cannot be inflated or parsed has a null doc and says why."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
           .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return parsed(raw.mapInPandas(_inflate, "path string, body string, error string"))


def parsed(texts: DataFrame) -> DataFrame:
    """(path, doc, error) from (path, body, error)."""
    doc = F.try_parse_json("body")
    return texts.select("path", doc.alias("doc"),
                        F.coalesce("error", F.when(F.col("body").isNotNull() & doc.isNull(), "malformed")).alias("error"))


def explode_points(docs: DataFrame, doc: str = "doc", base: str = "$.timestamp", array: str = "$.trace",
                   min_fields: int = 9, keep: Sequence[str] = ()) -> DataFrame:
    """One row per usable entry [dt, lat, lon, alt|"ground", gs, track, flags, vrate, details].

    Short entries and entries without a position are left out; an absent base counts as 0. Whatever is
    not the word ground is in the air, a missing altitude too; an empty callsign is none.
    `t` is in epoch seconds, `seq` the place in the array; columns of `docs` in `keep` are carried.
    """
    d = F.col(doc)
    get = lambda path, kind: F.try_variant_get(F.col("e"), path, kind)
    entries = docs.select(
        *keep,
        F.try_variant_get(d, "$.icao", "string").alias("hex"), F.try_variant_get(d, "$.t", "string").alias("actype"),
        F.try_variant_get(d, "$.r", "string").alias("reg"),
        F.coalesce(F.try_variant_get(d, base, "double"), F.lit(0.0)).alias("t0"),
        F.posexplode(F.try_variant_get(d, array, "array<variant>")).alias("seq", "e"))
    return (entries
            .where((F.size(F.try_variant_get(F.col("e"), "$", "array<variant>")) >= min_fields)
                   & get("$[1]", "double").isNotNull() & get("$[2]", "double").isNotNull())
            .select(*keep, "hex", "actype", "reg", F.col("seq").cast("long").alias("seq"),
                    (F.col("t0") + get("$[0]", "double")).alias("t"),
                    get("$[1]", "double").alias("lat"), get("$[2]", "double").alias("lon"),
                    F.coalesce(get("$[3]", "string") == "ground", F.lit(False)).alias("ground"), get("$[4]", "double").alias("gs"),
                    get("$[5]", "double").alias("track"),
                    (F.coalesce(get("$[6]", "long"), F.lit(0)).bitwiseAND(1) == 1).alias("stale"),
                    F.nullif(F.trim(get("$[8].flight", "string")), F.lit("")).alias("callsign")))
