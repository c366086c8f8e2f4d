"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the frequent pre-tokens' lengths, broadcast to all tasks.
It is made from the whole corpus without moving pre-tokens: each task keeps a bounded
summary of heavy hitters (a counter per piece, all lowered together when full, so that no
piece commoner than 1/SUMMARY of the task's pieces is lost), and summaries are merged in a
tree whose nodes are bounded alike. Tier two is each worker's own cache, filled by
the tokenizer for pieces of neither tier. Both only save time: a count never depends on them.

A piece runs from a space before a character that is surely no white space up to the next such
space. No pre-token of a byte-level BPE crosses such a space, and white space before it
stays in one piece, so the counts of the pieces add up to the text's. Special strings in texts are
counted as the library does by default.

Null and empty texts have no bytes and tokens. Repeated rows and repeated ids each get a
row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import only, whole

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of a summary and so of the broadcast table; longer pieces aren't kept in it or in caches.
SUMMARY, PIECE_BYTES, CACHE = 16_384, 48, 500_000
#: A space before an ASCII character that isn't white space, or before the first byte of one that can't be.
_CUT = re.compile(rb" (?=[!-~\xc3-\xdf\xe4-\xf4])")
_counters: dict[str, "Lengths"] = {}


def pieces(text: bytes) -> list[bytes]:
    """The text cut before such spaces; all pieces but the first lack their space."""
    return _CUT.split(text)


class Lengths:
    """Tier two: a tokenizer and a bounded cache from pieces to numbers of tokens."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def of(self, wanted: list[bytes]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast([p.decode() for p in wanted], add_special_tokens=False)]


def lengths(name: str) -> Lengths:
    if name not in _counters:
        _counters[name] = Lengths(name)
    return _counters[name]


def thinned(counts: Counter, size: int) -> Counter:
    """At most `size` entries: the count of the next one is taken off all."""
    if len(counts) <= size:
        return counts
    least = heapq.nlargest(size + 1, counts.values())[-1]
    return Counter({k: v - least for k, v in counts.items() if v > least})


def frequent(texts: DataFrame, size: int = SUMMARY, fan: int = 64) -> Counter:
    """A bounded summary of the heavy hitters among all pieces after a space."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update([p for p in pieces(t)[1:] if len(p) <= PIECE_BYTES])
                if len(counts) > 8 * size:
                    counts = thinned(counts, size)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(dict(thinned(counts, size)))], pa.binary())], names=["part", "summary"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for blob in rows.summary:
            counts.update(pickle.loads(blob))
            counts = thinned(counts, 2 * size)
        return pd.DataFrame({"part": [int(rows.part.iloc[0])], "summary": [pickle.dumps(dict(thinned(counts, size)))]})

    kinds = "part long, summary binary"
    level, parts = texts.select(whole().alias("text")).mapInArrow(summarise, kinds), texts.rdd.getNumPartitions()
    while True:  # a tree of merges; the last level is one summary of at most `size` entries
        level = level.groupBy((F.col("part") / fan).cast("long").alias("group")).applyInPandas(
            lambda key, rows: merge(rows.assign(part=key[0])), kinds)
        parts = -(-parts // fan)
        if parts <= 1:
            break
    top = level.collect()
    return Counter(pickle.loads(top[0]["summary"])) if top else Counter()


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, text: str = "text", size: int = SUMMARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    base = only(docs, "doc_id", text).select(F.col("doc_id").cast("long").alias("doc_id"), whole(text).alias("text"))
    common = list(frequent(base.select("text"), size))
    own = lengths(tokenizer)
    table = base.sparkSession.sparkContext.broadcast(dict(zip(common, own.of([b" " + p for p in common]))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, tier = table.value, lengths(tokenizer)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n_tokens: list[int] = []
            for lo in range(0, len(texts), 500):
                split = [pieces(t) for t in texts[lo: lo + 500]]
                if len(tier.known) > CACHE:
                    tier.known = {}
                known = tier.known
                rest = [p for p in set().union(*[s[1:] for s in split]) if p not in first and p not in known]
                new = dict(zip(rest, tier.of([b" " + p for p in rest])))
                known.update((p, n) for p, n in new.items() if len(p) <= PIECE_BYTES)
                heads = tier.of([s[0] for s in split])
                for head, s in zip(heads, split):
                    got = [first.get(p) or known.get(p) or new[p] for p in s[1:]]
                    n_tokens.append(head + sum(got))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return base.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
