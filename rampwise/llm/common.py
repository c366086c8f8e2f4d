"""What the operators share: reading tables, row keys, whole-text columns, packed arrays."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.session import pin_utc, scratch_path

WHITE = "\\x20\\x09-\\x0D"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once a context, wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_rampwise_sent", None) is None:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="rampwise-source-"), "rampwise_source.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "rampwise")):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
        sc.addPyFile(path)
        sc._rampwise_sent = path
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(ship(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """These columns alone; extra columns with clashing names never reach an operator's own."""
    return df.select(*[F.col(c) for c in cols])


def whole(text: str = "text") -> Column:
    """The text; a null one is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def once(c: Column) -> Column:
    """The column, made exactly once for a row: what isn't deterministic is neither repeated in functions of elements nor moved below a filter."""
    return F.when(F.spark_partition_id() >= 0, c)


def row_hash(text: str = "text") -> Column:
    """With the id it tells rows of different texts apart."""
    return F.xxhash64(whole(text))


def on_row(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Documents joined (left_semi or left_anti) with doc_id and h of marks; a null id matches a null id."""
    m = marks.select(F.col("doc_id").alias("_mark_id"), F.col("h").alias("_mark_h"))
    return docs.join(m, docs["doc_id"].cast("long").eqNullSafe(m["_mark_id"]) & (row_hash() == m["_mark_h"]), how)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: narrower than a checkpoint where rows are small."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [v or b"" for v in column.cast(pa.large_string() if pa.types.is_large_string(column.type) else pa.string()).cast(
        pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text, so that what Python makes of one is bounded whatever a batch holds; a longer text stands alone."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(at, end - at)
            at, before = end, int(upto[end - 1])


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Inside, rows reach Python in batches of about `most` bytes, on the JVM's side too: rows of packed arrays are megabytes wide. The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go when it ends, not when the driver happens to collect its garbage: what is kept is written. The session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --- hashing words of many texts at once ---------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEED = np.random.default_rng(20_240_501)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_LANES = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes beyond which a word is hashed on its own.
LONG_WORD = 48
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            for k, r in enumerate((_BASE, inverse)):
                step = np.full(n, np.uint64(r % 2**64))
                step[0] = 1
                _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in `data`, and how many words lie before each text's end.

    A word is a run of bytes other than white space; A-Z count as a-z; no word crosses a text's end.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    space = SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[0] = True
    cut[ends] = True
    first = cut[:-1].copy()
    first[1:] |= space[:-1]
    first &= ~space
    last = cut[1:].copy()
    last[:-1] |= space[1:]
    last &= ~space
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up, out=run[1:])
        h = mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64) * _LANES[63])
    for i in np.flatnonzero(b - a > LONG_WORD).tolist():  # powers of an odd number modulo 2^64 can't tell some long words apart
        h[i] = int.from_bytes(hashlib.blake2b(data[a[i]: b[i]].tobytes().lower(), digest_size=8).digest(), "little")
    return h, np.searchsorted(a, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - k + 1, np.uint64(k) * _LANES[62])
        for j in range(k):
            total += words[j: len(words) - k + 1 + j] * _LANES[j]
    return mix(total)


def slices(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def word_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; fewer words are one run, none give nothing."""
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        ends = np.cumsum([len(t) for t in part])
        words, upto = word_hashes(np.frombuffer(b"".join(part), np.uint8), ends)
        grams = gram_hashes(words, k)
        a = 0
        for b in upto.tolist():
            if b - a >= k:
                yield np.unique(grams[a: b - k + 1])
            elif b > a:
                yield gram_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
            a = b
