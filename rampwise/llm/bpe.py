"""BPE encoding and decoding, exactly as the tokenizers library does it.

Pieces between ASCII white space are encoded apart: no pre-token, special string or
composed character of this tokenizer crosses white space. Short pieces go through a
bounded cache in each worker. A long unsplit run, which the library would treat as one
word, is halved down to leaves; the leaves are encoded in parallel as rows of their own
and joined as a tree: around each join a growing window is encoded again until it
shares a token with the left side and a later one with the right side. An encoding is
right exactly when each pair of neighbours is, so the joined one is the library's.

Null and empty texts give no tokens. Repeated rows give repeated results; rows are never
merged by id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import digest, only, whole

TOKENIZER = "word_bpe_49k.json"
#: Byte-level characters in a leaf of a long run; a run of over two leaves is split.
LEAF = 2048
#: Pieces that a worker's cache holds before it starts anew; longer pieces aren't cached.
CACHE, CACHED_LENGTH = 400_000, 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_coders: dict[str, "Coder"] = {}


class Coder:
    """A tokenizer in a worker, with its cache of pieces."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.name = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def pair(self, ids) -> tuple[bytes, bytes]:
        """The ids' bytes and, for decoding, their tokens joined by spaces."""
        return np.asarray(ids, "<u4").tobytes(), " ".join([self.name[i] for i in ids]).encode()

    def learn(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return {p: self.pair(e.ids) for p, e in zip(pieces, found)}

    def texts(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of each text; white space parts the pieces."""
        split = [t.split() for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        missing = [p for p in set().union(*split) if p not in known]
        new = self.learn(missing)
        known.update((p, v) for p, v in new.items() if len(p) <= CACHED_LENGTH)
        new = {p: v for p, v in new.items() if len(p) > CACHED_LENGTH}
        out = []
        for pieces in split:
            got = [known.get(p) or new[p] for p in pieces]
            out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[0]])))
        return out

    def words(self, piece: str) -> Iterator[tuple[int, str]]:
        """(special id, '') or (-1, byte-level word) for the pre-tokens of a piece."""
        for part in self.at_special.split(piece):
            if part in self.special:
                yield self.special[part], ""
            elif part:
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    yield -1, word

    def run(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of a run of byte-level characters and the place where each begins."""
        got = self.tokenizer.model.tokenize(word)
        return [t.id for t in got], [t.offsets[0] for t in got]


def coder(name: str) -> Coder:
    if name not in _coders:
        _coders[name] = Coder(name)
    return _coders[name]


def starts_of(c: Coder, word: str, ids: list[int]) -> list[int]:
    """Where tokens begin, in byte-level characters."""
    at, out = 0, []
    for i in ids:
        out.append(at)
        at += len(c.name[i].removesuffix("</w>"))
    assert at == len(word)
    return out


def join(c: Coder, left: str, a: list[int], right: str, b: list[int], window: int = 64) -> list[int]:
    """The ids of left + right, given the ids of both; only windows around the join are encoded again."""
    at_a, at_b = starts_of(c, left, a), starts_of(c, right, b)
    seam, whole_run = len(left), left + right
    while True:
        lo, hi = max(0, seam - window), min(len(whole_run), seam + window)
        ids = [t.id for t in c.tokenizer.model.tokenize(whole_run[lo:hi])]
        at = [lo + x for x in starts_of(c, whole_run[lo:hi], ids)]
        if lo == 0 and hi == len(whole_run):
            return ids
        mine = dict(zip(at, zip(ids, range(len(ids)))))
        # a shared token on the left that ends before the seam, and one on the right
        p = (0, 0) if lo == 0 else next(((i, mine[x][1]) for i in range(len(a) - 1, -1, -1) if (x := at_a[i]) >= lo and x in mine and mine[x][0] == a[i]), None)
        q = (len(b), len(ids)) if hi == len(whole_run) else next(((j, mine[x][1]) for j in range(len(b)) if (x := at_b[j] + seam) < hi and x in mine and mine[x][0] == b[j]), None)
        if p and q and p[1] <= q[1]:
            return a[: p[0]] + ids[p[1]: q[1]] + b[q[0]:]
        window *= 2


def joined(c: Coder, leaves: list[tuple[str, list[int]]]) -> list[int]:
    """Leaves of one run joined pairwise, level by level."""
    while len(leaves) > 1:
        leaves = [(leaves[i][0] + leaves[i + 1][0], join(c, *leaves[i], *leaves[i + 1])) if i + 1 < len(leaves) else leaves[i]
                  for i in range(0, len(leaves), 2)]
    return leaves[0][1]


def halves(word: str, leaf: int) -> list[str]:
    if len(word) <= leaf:
        return [word]
    mid = len(word) // 2
    return halves(word[:mid], leaf) + halves(word[mid:], leaf)


def _columns(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist() if batch.column(name).type == pa.string() else batch.column(name).cast(pa.large_binary()).to_pylist()


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, leaf: int = LEAF, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256; with `keep_ids` also ids and decoded."""
    schema = RESULT + (", ids array<long>, decoded string" if keep_ids else "")
    base = only(docs, "doc_id", text).select(F.col("doc_id").cast("long").alias("doc_id"), whole(text).alias("text"))
    # a piece without white space that may hold a run of over two leaves
    long = F.col("text").rlike(f"(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D]{{{max(1, leaf // 2)},}}+")

    def result(ids: list[int | None], pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        cols = [pa.array(ids, pa.int64()), pa.array([len(p[0]) // 4 for p in pairs], pa.int64()),
                pa.array([digest(p[0]) for p in pairs], pa.string()), pa.array([digest(p[1]) for p in pairs], pa.string())]
        if keep_ids:
            cols += [pa.array([np.frombuffer(p[0], "<u4").astype(np.int64) for p in pairs], pa.list_(pa.int64())),
                     pa.array([p[1].decode() for p in pairs], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), _columns(batch, "text")
            for lo in range(0, len(ids), 500):
                yield result(ids[lo: lo + 500], c.texts(texts[lo: lo + 500]))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text with long pieces as numbered parts: ids at once for what is short, leaves for long runs."""
        c = coder(tokenizer)
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), _columns(batch, "text")):
                key, rows, seq = digest(repr(i).encode() + b"\0" + t), [], 0

                def put(run, ids=None, leaf_no=0):
                    rows.append((key, i, seq, leaf_no, run, ids))

                short_pieces: list[bytes] = []

                def flush():
                    nonlocal seq
                    if short_pieces:
                        put(None, c.texts([b" ".join(short_pieces)])[0][0])
                        short_pieces.clear()
                        seq += 1

                for piece in t.split():
                    if len(piece) * 2 <= leaf:
                        short_pieces.append(piece)
                        continue
                    flush()
                    for special, word in c.words(piece.decode()):
                        if special >= 0 or len(word) <= 2 * leaf:
                            put(None, np.asarray([special] if special >= 0 else c.run(word)[0], "<u4").tobytes())
                        else:
                            for no, run in enumerate(halves(word, leaf)):
                                put(run, leaf_no=no)
                        seq += 1
                flush()
                put(None, b"")  # so that a text without tokens has a row
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["key", "doc_id", "seq", "leaf", "run", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            got = [np.asarray(c.run(r)[0], "<u4").tobytes() if r is not None else b for r, b in zip(batch.column("run").to_pylist(), batch.column("ids").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(got, pa.binary()))

    def whole_text(rows: pd.DataFrame) -> pd.DataFrame:
        """One group is one text (and its repeated rows)."""
        c = coder(tokenizer)
        copies = Counter(zip(rows.seq, rows.leaf))[(rows.seq.iloc[0], rows.leaf.iloc[0])]
        rows = rows.drop_duplicates(["seq", "leaf"]).sort_values(["seq", "leaf"])
        ids: list[int] = []
        for _, unit in rows.groupby("seq", sort=True):
            lists = [np.frombuffer(b, "<u4").tolist() for b in unit.ids]
            ids += lists[0] if unit.run.iloc[0] is None else joined(c, list(zip(unit.run, lists)))
        first = rows.doc_id.iloc[0]
        table = result([None if pd.isna(first) else int(first)] * copies, [c.pair(ids)] * copies)
        return table.to_pandas()

    kinds = "key string, doc_id long, seq long, leaf long, run string, ids binary"
    spread = base.where(long).mapInArrow(parts, kinds).repartition("key", "seq", "leaf").mapInArrow(leaves, kinds)
    return base.where(~long).mapInArrow(short, schema).unionByName(spread.groupBy("key").applyInPandas(whole_text, schema))
