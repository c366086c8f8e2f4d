"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A window is `window` consecutive words of an item (a shorter item is one window). Of the
hashes of k-grams in a window the smallest is its fingerprint. Equal windows have equal
fingerprints, so each shared window, and hence each longer span, is found by joining the fingerprints of
both sides; neighbouring windows of one fingerprint go as one row. Then hits are extended:
a document's windows under a hit fingerprint are compared word for word with the items'
distinct windows, and the words of equal ones are counted once each.

The distinct items of a window stay one row each, and a window of a document is joined with at most
one distinct window, so a passage that many documents and items share never makes pairs of
documents. Fingerprints of items are broadcast only if Spark measures them to be small;
otherwise the same join shuffles.

Null and empty texts have no words and no hits; items without words have no window; of null item ids
only the hits count. Repeated rows get the same result each; rows of one id with different texts are told
apart. Extra columns are ignored; an empty table of either side gives zeros or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import on_row, row_hash, whole
from rampwise.session import pinned

WINDOW, GRAM = 10, 5
#: Separators: all ASCII but digits and small letters, after lower-casing A-Z.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z alone; in a text of single bytes that is plain lower-casing."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.filter(F.split(low, SEPARATOR), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(
        F.array().cast("array<bigint>"))


def fingerprints(hashes: Column, span: int) -> Column:
    """For each `span` neighbouring hashes the smallest."""
    return F.when(F.size(hashes) >= span, F.transform(F.sequence(F.lit(1), F.size(hashes) - span + 1), lambda i: F.array_min(F.slice(hashes, i, span)))).otherwise(
        F.array().cast("array<bigint>"))


def _exploded(rows: DataFrame, keys: list[str], array: Column, *fields: str) -> DataFrame:
    """The array's elements as rows. The outer form keeps the optimizer from testing the array, and so making it, once more below."""
    return rows.select(*keys, F.explode_outer(array).alias("x")).where(F.col("x").isNotNull()).select(*keys, *[f"x.{f}" for f in fields])


def marked(rows: DataFrame, keys: list[str], window: int) -> DataFrame:
    """A row for each run of windows with one fingerprint: its hash, first window and words."""
    k = min(GRAM, window)
    rows = rows.select(*keys, "words", grams(F.col("words"), k).alias("hashes"))
    rows = rows.select(*keys, "words", fingerprints(F.col("hashes"), window - k + 1).alias("prints"))
    first = F.filter(F.transform("prints", lambda h, i: F.struct(h.alias("print"), i.alias("at"))), lambda x, i: (i == 0) | (F.get("prints", i - 1) != x["print"]))
    rows = rows.select(*keys, "words", F.size("prints").alias("n"), first.alias("first"))
    run = F.transform("first", lambda x, i: F.struct(x["print"].alias("print"), x["at"].alias("at"), F.slice(
        F.col("words"), x["at"] + 1, F.coalesce(F.get(F.col("first"), i + 1)["at"], F.col("n")) - x["at"] + window - 1).alias("run")))
    return _exploded(rows, keys, run, "print", "at", "run")


def windows_in(rows: DataFrame, keys: list[str], window: int) -> DataFrame:
    """A row for each window of the runs, as text."""
    each = F.transform(F.sequence(F.lit(1), F.size("run") - window + 1), lambda i: F.struct((F.col("at") + i - 1).alias("at"), F.concat_ws(" ", F.slice("run", i, window)).alias("win")))
    return _exploded(rows, [*keys, "print"], each, "at", "win")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("h"), words_of(whole()).alias("words"))


def found_in(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, h, n_hit and the sorted item ids of documents with a hit."""
    rows = _rows(docs)
    tests = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(whole()).alias("words")).where(F.size("words") > 0)
    tests = tests.withColumn("span", F.least(F.size("words"), F.lit(window)))
    spans = sorted({r[0] for r in tests.select("span").distinct().collect()} | {window})  # at most `window` numbers
    covers = item_hits = None
    for span in spans:
        own = tests.where(F.col("span") == span)
        known = windows_in(marked(own, ["item_id"], span), ["item_id"], span).select("item_id", "print", "win").distinct()
        found = marked(rows, ["doc_id", "h"], span).join(known.select("print").distinct(), "print", "left_semi")
        met = pinned(windows_in(found, ["doc_id", "h"], span).join(known.select("print", "win").distinct(), ["print", "win"], "left_semi"))  # hits only; read twice below
        cover = met.select("doc_id", "h", "at", F.lit(span).alias("span"))
        item = met.select("doc_id", "h", "print", "win").distinct().join(known, ["print", "win"]).select("doc_id", "h", "item_id").distinct()
        covers = cover if covers is None else covers.unionByName(cover)
        item_hits = item if item_hits is None else item_hits.unionByName(item)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    spans_of = F.array_sort(F.collect_set(F.struct("at", "span")))
    n_hit = F.aggregate(spans_of, zero, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["span"] - F.greatest(x["at"], acc["end"]))).cast("long").alias("n"),
        F.greatest(acc["end"], x["at"] + x["span"]).alias("end")), lambda acc: acc["n"])
    covers = covers.groupBy("doc_id", "h").agg(n_hit.alias("n_hit"))
    ids = F.array_sort(F.collect_set("item_id"))
    item_hits = item_hits.groupBy("doc_id", "h").agg(ids.alias("ids"))
    return covers.join(item_hits, (covers.doc_id.eqNullSafe(item_hits.doc_id)) & (covers.h == item_hits.h), "left").select(
        covers.doc_id.alias("doc_id"), covers.h.alias("h"), "n_hit", "ids")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns."""
    return on_row(docs, pinned(found_in(docs, items, window).select("doc_id", "h")), "left_anti")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    both = found_in(docs, items, window).withColumnsRenamed({"doc_id": "d", "h": "g"})
    counts = _rows(docs).select("doc_id", "h", F.size("words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counts.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("ids", none)), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
