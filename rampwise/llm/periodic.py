"""Periodic runs of words: stretches that repeat a period at least `TIMES` times and can't be extended.

Every maximal run holds a Lyndon word as its root: for the order of words or for its inverse, the longest Lyndon word that begins at some place of the run has the run's period as its
length. So for each place and both orders there is one candidate, which is extended to both sides by longest common extensions (LCE). An LCE of two
places is the string depth of their leaves' lowest common ancestor in the suffix tree of the text, to the left in that of its reversal. The trees are built by
Ukkonen's algorithm; one Euler tour gives the leaves in order with the depth of the ancestor between each two, and a table of minima over powers of two answers in constant time.

Before that, places are set aside that no run can hold: inside a run of at least 24 words and three periods, each window of `WINDOW` words
occurs twice in the text. Only stretches of such windows get trees. A run lies in one stretch with all words that extend it, so none is lost or cut.

Documents are independent and never leave their row; a worker holds one text with the trees of one of its stretches, about half a
kilobyte for each word of the longest stretch.

A null text has no words. Texts with fewer than `LEAST` words have no runs. Repeated rows are each judged. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import gram_hashes, mix, text_bytes

#: A run has at least so many words and so many periods. A window of 8 words recurs in each such run at all its places: the length less two
#: periods is at least 8, whatever the period.
LEAST, TIMES, WINDOW = 24, 3, 8


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers, with an end mark that is less than each of them."""

    def __init__(self, seq: list[int]):
        s = [x + 1 for x in seq] + [0]
        self.n, self.k = len(s), max(s) + 1
        k, n = self.k, self.n
        edge: dict[int, int] = {}  # node * k + letter -> child
        start, stop, link = [0], [0], [0]
        leaves = []  # in the order of their suffixes
        node = at = length = left = 0
        for i, c in enumerate(s):
            last = 0
            left += 1
            while left:
                if not length:
                    at = i
                key = node * k + s[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    leaves.append(len(start))
                    start.append(i), stop.append(n), link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    wide = stop[child] - begin
                    if length >= wide:
                        at, length, node = at + wide, length - wide, child
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    inner = len(start)
                    start.append(begin), stop.append(begin + length), link.append(0)
                    edge[key] = inner
                    leaf = inner + 1
                    start.append(i), stop.append(n), link.append(0)
                    leaves.append(leaf)
                    edge[inner * k + c] = leaf
                    start[child] = begin + length
                    edge[inner * k + s[begin + length]] = child
                    if last:
                        link[last] = inner
                    last = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - left + 1
        size = len(start)
        self.width = np.array(stop, np.int64) - np.array(start, np.int64)
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        child = np.fromiter(edge.values(), np.int64, len(edge))
        order = np.argsort(keys)
        self.child, self.letter = child[order], keys[order] % k
        self.first = np.searchsorted(keys[order] // k, np.arange(size + 1))
        self.suffix = np.full(size, -1, np.int64)
        self.suffix[leaves] = np.arange(n)

    def tour(self, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order (of words, or of its inverse; the end mark comes first in both), and before each the depth of the ancestor shared with the one before."""
        child, first, width, suffix = self.child, self.first.tolist(), self.width.tolist(), self.suffix.tolist()
        if inverse:  # all children but the end mark the other way round
            group = np.repeat(np.arange(len(first) - 1), np.diff(self.first))
            child = child[np.lexsort((np.where(self.letter == 0, 0, self.k - self.letter), group))]
        child = child.tolist()
        order, shared, low = [], [], 0
        todo = [(0, 0, -1)]  # node, depth, depth of the parent if the node isn't its first child
        while todo:
            node, depth, up = todo.pop()
            if up >= 0:
                low = up
            if suffix[node] >= 0:
                order.append(suffix[node]), shared.append(low)
                continue
            a, b = first[node], first[node + 1]
            for j in range(b - 1, a, -1):
                x = child[j]
                todo.append((x, depth + width[x], depth))
            x = child[a]
            todo.append((x, depth + width[x], -1))
        return np.array(order), np.array(shared)


class Extensions:
    """Longest common extensions of pairs of places in constant time each."""

    def __init__(self, order: np.ndarray, shared: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [shared.astype(np.int32)]
        while 2 << len(self.table) - 1 <= len(shared):
            t, w = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(t[:-w], t[w:]))
        self.log = np.zeros(len(shared) + 1, np.int64)
        self.log[1:] = np.log2(np.arange(1, len(shared) + 1)).astype(np.int64)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same, for i <> j."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level, out = self.log[b - a], np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            t = self.table[k]
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << k)])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one whose suffix is smaller: the end of the longest Lyndon word from there."""
    n = len(rank)
    out, held = np.empty(n, np.int64), []
    ends = [n] * n
    for i, r in enumerate(rank):
        while held and rank[held[-1]] > r:
            ends[held.pop()] = i
        held.append(i)
    out[:] = ends
    return out


def maximal_runs(seq: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length and smallest period of all maximal runs that are long enough (times >= 2), in order."""
    n = len(seq)
    if n < max(least, times):
        return []
    tree = SuffixTree(seq)
    order, shared = tree.tour()
    ahead = Extensions(order, shared)
    inverse = np.empty(n + 1, np.int64)
    inverse[tree.tour(inverse=True)[0]] = np.arange(n + 1)
    del tree
    back = Extensions(*SuffixTree(seq[::-1]).tour())
    found = set()
    for rank in (ahead.rank, inverse):
        i = np.arange(n)
        j = _next_smaller(rank.tolist())[:n]  # the end mark is smaller than all
        period = j - i
        some = period * times <= n
        i, j, period = i[some], j[some], period[some]
        right = ahead.of(i, j)  # j = n: the end mark's own suffix, which shares nothing
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back.of(n - i[inner], n - j[inner])
        start, length = i - left, left + period + right
        good = length >= np.maximum(least, times * period)
        found.update(zip(start[good].tolist(), length[good].tolist(), period[good].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, window: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` words in which each window of words occurs again in the text."""
    if len(ids) < least:
        return []
    h = gram_hashes(mix(ids.astype(np.uint64)), window)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h) + 2, bool)
    again[order[1:][same] + 1] = True
    again[order[:-1][same] + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(a, b + window - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + window - 1 - a >= least]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length and period of each run of a text's words."""
    if len(words) < LEAST:
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    found = []
    for a, b in stretches(ids, WINDOW, LEAST):
        part = np.unique(ids[a:b], return_inverse=True)[1].tolist()
        found += [(a + s, n, q) for s, n, q in maximal_runs(part)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one of ten documents, by crc32 of the decimal id, the words from a place on become periodic. Nothing is planted under a null id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def collapsed(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the run of the greatest exponent (least start, then period; null without runs), runs and
    collapsed: the words, but for those that a run holds after its first period, joined by spaces. `prepare` may change a document's words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                words = data.split()  # bytes: at space and the bytes 9 to 13 only
                if prepare:
                    words = prepare(doc_id, words)
                runs = runs_of(words)
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    words = [w for w, x in zip(words, np.cumsum(gone).tolist()) if not x]
                out.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(words).decode()))
            n, start, length, period, milli, runs, text = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, start, length, period, milli)],
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(text, pa.string())],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                "runs array<struct<start:long, length:long, period:long>>, collapsed string")
