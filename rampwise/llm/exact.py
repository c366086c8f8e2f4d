"""Exact duplicates by progressive refinement: length, then a hash of the first bytes, then a hash of the whole text.

1. Rows are counted by their length in bytes. A length that only one row has ends that row's search.
2. Of the others, rows are counted by length and the hash of their first `PREFIX` bytes.
3. Only rows that share both have their whole text hashed; equal (length, SHA-256) is one group.

Which lengths, and which (length, prefix) pairs, are shared is kept in a sieve: a bitmap of `SIEVE` bits whatever the data, dealt in
pages of 4 KB, so it is broadcast with a fixed bound. Two keys may share a bit; that lets a row through to the next level, where it
is told apart, so the sieve decides how much is hashed and never what is equal. No text is ever shuffled: a row travels as id, digest and number.

A group may hold a third of all rows. Groups are reduced with partial aggregation. Those with more than 1/`HOT` of all rows are fewer than `HOT`
and are given to their rows by broadcast; the rest are joined, and rows that already have their group, or that need none, are dealt by
a key of their own.

A null text counts as empty, and all empty texts are one group. The row of the largest id stays; a null id loses to any other, and a group
of null ids alone keeps a null keep_id. Of rows repeated under the largest id exactly one stays. A row without an equal is kept, whatever its id.
Extra columns are ignored. An empty table gives an empty result. A text of any length is hashed in one pass where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import stored, whole
from rampwise.session import pinned

#: Bytes of the text hashed on the second level; bits of a sieve and of one of its pages; groups beyond 1/HOT of all rows are hot.
PREFIX, SIEVE, PAGE, HOT = 256, 1 << 25, 1 << 15, 1000


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """page and bits: the bits of those keys (longs) that come in several rows of `keys`."""
    return sieve_of(keys.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), key)


def sieve_of(keys: DataFrame, key: str) -> DataFrame:
    """page and bits: the bits of all keys (longs) of `keys`."""
    bits = keys.select(F.pmod(F.col(key), F.lit(SIEVE)).alias("bit"))
    return pinned(bits.select(F.floor(F.col("bit") / PAGE).cast("long").alias("page"), (F.col("bit") % PAGE).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")))


def passing(rows: DataFrame, key: Column, table: DataFrame, flag: str) -> DataFrame:
    """The rows with a flag: whether the sieve lets their key through. At most SIEVE / PAGE pages of 4 KB are broadcast."""
    bit = F.pmod(key, F.lit(SIEVE))
    found = rows.withColumn("_bit", bit % PAGE).withColumn("_page", F.floor(bit / PAGE).cast("long"))
    found = found.join(F.broadcast(table.withColumnRenamed("page", "_held")), F.col("_page") == F.col("_held"), "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(flag, F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))).drop("_bit", "_page", "_held", "bits")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of rows repeated under one id with one text any one stays."""
    rows = docs.withColumn("_full", F.sha2(F.encode(whole(text), "utf-8"), 256))
    marks = grouped(docs, doc_id, text, digests=True).groupBy(F.col("doc_id").alias("_mark_id"), F.col("text_sha256").alias("_mark_full")).agg(F.max("kept").alias("_stays"), F.count("*").alias("_times"))
    marks = stored(marks.where("NOT _stays OR _times > 1"), "exact-marks")

    def on(some: DataFrame, how: str) -> DataFrame:
        return rows.join(some, rows[doc_id].eqNullSafe(some["_mark_id"]) & (rows["_full"] == some["_mark_full"]), how)

    return on(marks, "left_anti").unionByName(on(marks.where("_stays"), "left_semi").dropDuplicates([doc_id, "_full"])).drop("_full")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept of every row, and n_bytes; with `digests` text_sha256 of every text, not only of those that had to be hashed."""
    data = F.encode(whole(text), "utf-8")
    base = docs.select(F.col(doc_id).alias("doc_id"), data.alias("data")).withColumn("n_bytes", F.octet_length("data").cast("long"))
    pair = F.xxhash64("n_bytes", F.substring("data", 1, PREFIX))
    lengths = sieve(base.select("n_bytes"), "n_bytes")
    one = passing(base, F.col("n_bytes"), lengths, "same_length")
    prefixes = sieve(one.where("same_length").select(pair.alias("pair")), "pair")
    two = passing(one, F.when(F.col("same_length"), pair), prefixes, "same_prefix")
    full = F.sha2("data", 256)
    rows = two.select("doc_id", "n_bytes", F.monotonically_increasing_id().alias("row"), F.when(F.col("same_prefix"), full).alias("full"),
                      *([full.alias("text_sha256")] if digests else []))
    rows = stored(rows, "exact-rows")  # read back, the numbers of rows stay
    top = F.max(F.struct("doc_id", "row")).alias("top")
    groups = pinned(rows.where("full IS NOT NULL").groupBy("n_bytes", "full").agg(F.count("*").alias("group_size"), top).where("group_size > 1")
                    .select(F.col("n_bytes").alias("_n"), F.col("full").alias("_full"), "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row")))
    total = rows.count()
    hot = groups.where(F.col("group_size") * HOT > total)
    cool = groups.where(F.col("group_size") * HOT <= total).select(F.col("_n").alias("c_n"), F.col("_full").alias("c_full"), F.col("group_size").alias("c_size"), F.col("keep_id").alias("c_id"), F.col("keep_row").alias("c_row"))
    told = rows.join(F.broadcast(hot), (F.col("full") == F.col("_full")) & (F.col("n_bytes") == F.col("_n")), "left")
    # the key of rows that need no further group is their own number: it meets nothing and is dealt evenly
    open_key = F.when(F.col("full").isNotNull() & F.col("group_size").isNull(), F.col("full")).otherwise(F.col("row").cast("string"))
    told = told.withColumn("_key", open_key).join(cool, (F.col("_key") == F.col("c_full")) & (F.col("n_bytes") == F.col("c_n")), "left")
    size, keep = F.coalesce("group_size", "c_size"), F.coalesce("keep_row", "c_row")
    return told.select(
        "doc_id", F.when(size.isNull(), F.col("doc_id")).otherwise(F.coalesce("keep_id", "c_id")).alias("keep_id"), F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep == F.col("row"), F.lit(True)).alias("kept"), "n_bytes", *(["text_sha256"] if digests else []))
