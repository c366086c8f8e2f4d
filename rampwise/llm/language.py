"""Language identification by Bayesian fusion of evidence.

log P(l | all) = w · Σ log P(trigram | l) + log P(declared | l) + log P(l | host), up to a constant, where the
last term holds the address's suffix as the top of its hierarchy.

The trigram tables are counted over all rows with a declared language; one more class, `und`,
spreads its mass evenly over all trigrams, so that noise which no language explains falls to it. The
votes of the text alone then give, by grouped aggregation over all rows, how languages
are declared, which address suffixes they have, and the priors of hosts: a host's counts are
smoothed by its domain's share, the domain's by the suffix's, and that by the share of all rows. A row is kept if its
best class isn't `und`.

Null and empty texts have no trigrams and are `und` (not kept). A null declared language,
suffix, domain or host gives no evidence of its kind. Equal posteriors go to the first language by name.
Repeated rows and ids each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import on_row, only, row_hash, slices, whole
from rampwise.llm.exact import HOT
from rampwise.session import pinned

LANGUAGES = ("de", "en", "es", "fr")
#: Trigrams are hashed to so many cells; WEIGHT tempers their dependence; STRENGTH is the rows' worth of a parent's prior.
CELLS, WEIGHT, STRENGTH, ADDED = 1 << 14, 0.25, 20.0, 0.5
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32  # all ASCII but letters reads as a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams of all texts, and how many come before each text's end; runs of spaces give none."""
    ends = np.cumsum([len(t) + 2 for t in texts])
    data = _FOLD[np.frombuffer(b"".join([b" " + t + b" " for t in texts]), np.uint8)]
    a, b, c = data[:-2], data[1:-1], data[2:]
    code = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) & np.uint32(0xFFFFFFFF)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    use = ((a != 32) | (b != 32)) & ((b != 32) | (c != 32))
    for edge in (ends[:-1] - 2, ends[:-1] - 1):  # none across texts
        use[edge] = False
    at = np.flatnonzero(use)
    return ((code[at] >> np.uint32(18)) % np.uint32(CELLS)).astype(np.int64), np.searchsorted(at, ends - 2)


def trained(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """log P(cell | language) with `und` last, from all rows whose declared language is one of these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            texts, own = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("declared").to_pylist()
            for k, language in enumerate(languages):
                mine = [t for t, x in zip(texts, own) if x == language]
                for lo, hi in slices(mine):
                    total[k] += np.bincount(trigrams(mine[lo:hi])[0], minlength=CELLS)
        for k in range(len(languages)):
            some = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int64()), pa.array(some, pa.int64()), pa.array(total[k][some], pa.int64())], names=["k", "cell", "n"])

    table = np.zeros((len(languages) + 1, CELLS))
    counted = rows.where(F.col("declared").isin(*languages)).select("text", "declared").mapInArrow(count, "k long, cell long, n long")
    for r in counted.groupBy("k", "cell").agg(F.sum("n").alias("n")).collect():  # at most languages x CELLS numbers
        table[r["k"], r["cell"]] = r["n"]
    table = table + ADDED
    return np.log(table / table.sum(axis=1, keepdims=True))


def scored(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows without text, with `ll`: tempered log likelihoods of the text, and `n_grams`."""
    held = rows.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sums, counts = [], []
            for lo, hi in slices(texts):
                cells, upto = trigrams(texts[lo:hi])
                run = np.zeros((len(cells) + 1, len(logs)))
                np.cumsum(logs.T[cells], axis=0, out=run[1:])
                edge = np.concatenate([[0], upto])
                sums.append(run[edge[1:]] - run[edge[:-1]])
                counts.append(np.diff(edge))
            ll = np.round(np.concatenate(sums) * WEIGHT, 6) if sums else np.zeros((0, len(logs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(list(ll), pa.list_(pa.float64())), pa.array(np.concatenate(counts) if counts else [], pa.int64())],
                names=[*keep, "ll", "n_grams"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(score, kinds + ", ll array<double>, n_grams long")


def best(scores: Column) -> Column:
    """Index of the first greatest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def votes(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """How many rows of each key vote for each class."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum((F.col("vote") == k).cast("double")) for k in range(n)]).alias("votes"))


def with_votes(rows: DataFrame, level: str, n: int, total: int) -> DataFrame:
    """The rows with the votes of their `level`; `_row` numbers the rows.

    Values with more than 1/HOT of all rows are fewer than HOT and are given to their rows by broadcast. The rest are joined, and rows
    that have their votes already, or no value, are dealt by their own number.
    """
    out = f"{level}_votes"
    table = pinned(votes(rows.where(F.col(level).isNotNull()), n, level).select(F.col(level).alias("_value"), F.col("votes").alias(out)))
    size = F.aggregate(F.col(out), F.lit(0.0), lambda s, x: s + x)
    hot = table.where(size * HOT > total).select(F.col("_value").alias("_hot_value"), F.col(out).alias("_hot_votes"))
    cool = table.where(size * HOT <= total).withColumn("_open_too", F.lit(True))
    told = rows.join(F.broadcast(hot), F.col(level) == F.col("_hot_value"), "left").withColumn("_open", F.col(level).isNotNull() & F.col("_hot_votes").isNull())
    told = told.withColumn("_deal", F.when(F.col("_open"), F.col(level)).otherwise(F.col("_row").cast("string")))
    met = told.join(cool, (F.col("_deal") == F.col("_value")) & (F.col("_open") == F.col("_open_too")), "left")
    return met.withColumn(out, F.coalesce(out, "_hot_votes")).drop("_hot_value", "_hot_votes", "_open", "_open_too", "_deal", "_value")


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def identified(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The rows without their text, with `language`, `confidence` and `kept`.

    `rows` has text, declared, suffix, domain and host beside what the caller carries.
    """
    languages = tuple(sorted(languages))
    names, n = [*languages, UNKNOWN], len(languages) + 1
    text = rows.withColumn("text", whole())
    base = scored(text, trained(text, languages))
    base = pinned(base.withColumn("vote", F.when(F.col("n_grams") > 0, best(F.col("ll"))).otherwise(n - 1)).withColumn("_row", F.monotonically_increasing_id()))  # read once more for each table of counts
    share = votes(base, n).first()  # one row
    overall = np.array(share["votes"] if share and share["votes"][0] is not None else [0.0] * n) + 1
    prior, total = vector(overall / overall.sum()), overall.sum() - n
    # how languages are declared: at most classes x classes numbers
    said = {r["declared"]: r["votes"] for r in votes(base.withColumn("declared", F.when(F.col("declared").isin(*languages), F.col("declared")).when(
        F.col("declared").isNotNull(), "other")), n, "declared").collect()}
    known = [*languages, "other"]
    seen = np.array([said.get(d, [0.0] * n) for d in known]) + 1
    told = np.log(seen / seen.sum(axis=0, keepdims=True))
    declared = F.lit(None)
    for d, row in zip(known, told):
        match = F.col("declared") == d if d != "other" else F.col("declared").isNotNull() & ~F.col("declared").isin(*languages)
        declared = F.when(match, vector(row)).otherwise(declared)
    zeros = vector([0.0] * n)
    smooth = lambda votes, parent: F.zip_with(votes, parent, lambda v, p: (v + STRENGTH * p) / (F.aggregate(votes, F.lit(0.0), lambda s, x: s + x) + STRENGTH))
    out = base
    for level in ("suffix", "domain", "host"):
        out = with_votes(out, level, n, int(total))
    out = out.withColumn("p", F.when(F.col("suffix").isNotNull(), smooth(F.col("suffix_votes"), prior)).otherwise(prior))
    out = out.withColumn("p", F.when(F.col("domain").isNotNull(), smooth(F.col("domain_votes"), F.col("p"))).otherwise(F.col("p")))
    out = out.withColumn("p", F.when(F.col("host").isNotNull(), smooth(F.col("host_votes"), F.col("p"))).otherwise(F.col("p")))
    out = out.withColumn("score", F.zip_with(F.zip_with("ll", F.coalesce(declared, zeros), lambda a, b: a + b), F.col("p"), lambda a, p: a + F.log(p)))
    out = out.withColumn("pick", F.when(F.col("n_grams") > 0, best(F.col("score"))).otherwise(n - 1))
    top = F.array_max("score")
    sure = F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    drop = ["_row", "ll", "n_grams", "vote", "suffix_votes", "domain_votes", "host_votes", "p", "score", "pick", "declared", "suffix", "domain", "host"]
    return out.withColumns({"language": F.get(F.array(*map(F.lit, names)), F.col("pick")), "confidence": F.when(F.col("n_grams") > 0, F.round(sure, 6)).otherwise(F.lit(1.0)),
                            "kept": F.col("pick") != n - 1}).drop(*drop)


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence of documents: the language column is what is declared, the source is the host."""
    d = only(docs, "doc_id", "text", "lang", "source")
    none = F.lit(None).cast("string")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lower(F.substring("lang", 1, 2)).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").alias("host"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that have a language, with all their columns."""
    told = identified(from_documents(docs).withColumn("h", row_hash()))
    return on_row(docs, pinned(told.where(~F.col("kept")).select("doc_id", "h").distinct()), "left_anti")


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence of pages: markup's language, and the address's suffix, domain and host; text is the markup without tags."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    p = only(pages, "page_id", "url", "html").withColumn("host", F.when(host != "", host))
    said = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*+>", " ")
    return p.select(F.col("page_id").cast("long").alias("page_id"), bare.alias("text"), F.when(said != "", said).alias("declared"),
                    F.element_at(F.split("host", r"\."), -1).alias("suffix"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), "host")
