"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a `LENGTH`-byte string that starts anywhere else too, in any text or the same, is removed.

1. Of the `GRAM`-byte grams in a window of LENGTH bytes, the one of smallest hash is its
   anchor. Equal windows have equal anchors at equal places, so a window is looked for under its
   anchor alone. Neighbouring windows of one anchor are one run; only runs whose anchor's hash
   comes more than once in the corpus go on, each with its bytes.
2. Under an anchor, the runs' bytes are cut into blocks counted from the anchor. The blocks,
   as numbers, are sorted as one sequence by `suffixes.suffix_array` (grouping by Lyndon prefixes).
   Only suffixes that share as many blocks with a neighbour as a window is sure to hold can begin a repeated window; those are compared over their whole length by hash, exactly
   up to a 64-bit collision under one anchor.
3. An anchor with over `MOST` runs isn't gathered: its windows are counted one by one, after
   a first count in each task, and the windows that come once are given back.

Null and empty texts lose nothing. Repeated rows are copies of each other. A null id is an id. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import digest, mix, pieces, powers, row_hash, slices, text_bytes, whole
from rampwise.llm.suffixes import suffix_array

LENGTH, GRAM, BLOCK, MOST, BATCH, WINDOWS = 200, 32, 40, 2_000, 20_000, 500_000
_BYTES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of `data`."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * up, out=run[1:])
        return mix((run[k:] - run[:-k]) * down[: n - k + 1])


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from minima within blocks of w seen from both sides."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = x
    grid = padded.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1: n])


def runs(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a slice of texts: its first text's number, then for each run the text, first and last window, anchor and the anchor's hash."""
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        data = np.frombuffer(b"".join(part), np.uint8)
        h = rolling(data, GRAM)
        if len(data) < length:
            continue
        least = window_least((h & ~np.uint64(2**28 - 1)) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        anchor = (least & np.uint64(2**28 - 1)).astype(np.int64)
        ends = np.cumsum([len(t) for t in part])
        begins = ends - [len(t) for t in part]
        own = np.repeat(np.arange(len(part)), [len(t) for t in part])[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= ends[own]
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        new = np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (own[at][1:] != own[at][:-1])])
        first = at[new]
        last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
        t = own[first]
        yield lo, t, first - begins[t], last - begins[t], anchor[first] - begins[t], h[anchor[first]].astype(np.int64)


def repeated_starts(anchors: np.ndarray, offsets: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For runs in order of their anchors' hash: which of each run's windows come in another run of that anchor. `texts` are the runs' bytes, `offsets` the anchor's place in them."""
    where: dict[tuple[int, int, bytes], int] = {}
    of, copies = [], []
    for a, o, t in zip(anchors.tolist(), offsets.tolist(), texts):
        k = where.setdefault((a, o, t), len(where))
        if k == len(copies):
            copies.append(0)
        copies[k] += 1
        of.append(k)
    kinds = list(where)
    own = np.array([k[0] for k in kinds], np.int64)
    sizes = np.array([len(k[2]) for k in kinds])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(k[2] for k in kinds), np.uint8)
    # blocks, counted from the anchor
    skip = np.array([k[1] for k in kinds]) % BLOCK
    n_blocks = np.maximum(0, (sizes - skip) // BLOCK)
    kind = np.repeat(np.arange(len(kinds)), n_blocks)
    number = np.arange(len(kind)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    at = begins[kind] + skip[kind] + number * BLOCK
    from_anchor = at - begins[kind] - np.array([k[1] for k in kinds])[kind]
    hashes = rolling(data, BLOCK)
    with np.errstate(over="ignore"):
        names = mix(hashes[at] ^ mix(own[kind].astype(np.uint64)) + from_anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(at) else np.zeros(0, np.uint64)
    symbols = np.unique(names, return_inverse=True)[1]
    # a number of its own after each run, so that no suffix is equal across a run's end
    place = np.arange(len(kind)) + kind
    sequence = np.zeros(len(kind) + len(kinds), np.int64)
    sequence[place] = symbols
    sequence[np.cumsum(n_blocks) + np.arange(len(kinds))] = len(names) + np.arange(len(kinds))
    order = np.array(suffix_array(sequence.tolist()), np.int64)
    sure = (length - BLOCK + 1) // BLOCK
    padded = np.concatenate([sequence, -1 - np.arange(sure)])
    same = np.ones(max(0, len(order) - 1), bool)
    for j in range(sure):
        same &= padded[order[1:] + j] == padded[order[:-1] + j]
    shared = np.zeros(len(sequence), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    # windows whose first whole block begins such a suffix
    n_windows = sizes - length + 1
    run = np.repeat(np.arange(len(kinds)), n_windows)
    start = np.arange(len(run)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    block = np.maximum(0, -(-(start - skip[run]) // BLOCK))
    maybe = shared[(np.cumsum(n_blocks) - n_blocks + np.arange(len(kinds)))[run] + block]
    hit = np.zeros(len(run), bool)
    if maybe.any():
        w = rolling(data, length)[(begins[run] + start)[maybe]]
        with np.errstate(over="ignore"):
            w = mix(w ^ mix(own[run[maybe]].astype(np.uint64)))
        _, back, n = np.unique(w, return_inverse=True, return_counts=True)
        hit[maybe] = n[back] > 1
    cut = np.cumsum(n_windows)[:-1]
    by_kind = np.split(hit, cut)
    return [np.ones(int(n_windows[k]), bool) if copies[k] > 1 else by_kind[k] for k in of]


def without_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST, text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with `keep_text` also the bytes left."""
    # a row's key has no null, so that what is grouped by it is dealt as the joins need it; the hash tells a null id from 0
    id = F.col("doc_id").cast("long")
    h = F.when(id.isNull(), F.bitwise_not(row_hash(text))).otherwise(row_hash(text))
    base = docs.select(id.alias("doc_id"), h.alias("h"), whole(text).alias("text"))

    def on_key(some: DataFrame, how: str) -> DataFrame:
        """Texts with what some tell of their keys; all such joins deal the same columns, so texts are shuffled once."""
        some = some.withColumnRenamed("h", "k")
        return base.join(some, (F.coalesce(base.doc_id, F.lit(0)) == some.id) & (base.h == some.k), how)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, hs = batch.column("id"), batch.column("h")
            for lo, t, first, last, anchor, g in runs(text_bytes(batch.column("text")), length):
                at = pa.array(t + lo)
                yield pa.RecordBatch.from_arrays([ids.take(at), hs.take(at), pa.array(g), pa.array((first * length + last - first) * length + anchor - first)], names=["id", "h", "g", "run"])

    # a run is one number: its first window, how many more it has and how far its anchor is
    found = base.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "h", "text").mapInArrow(anchors, "id long, h long, g long, run long")
    counts = found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    lists = found.join(counts, "g").select("id", "h", "g", "run", (F.col("n") > most).alias("hot")).repartition("id", "h").groupBy("id", "h").agg(
        F.collect_set(F.struct("g", "run", "hot")).alias("runs"))

    def with_runs(hot: bool) -> DataFrame:
        some = F.transform(F.filter("runs", lambda r: r["hot"] == F.lit(hot)), lambda r: F.struct(r["g"].alias("g"), r["run"].alias("run")))
        return on_key(lists.select("id", "h", some.alias("runs")).where(F.size("runs") > 0), "inner").select("id", "h", "text", "runs")

    def opened(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Of about `most` bytes of a batch's runs at a time: their rows, anchors' hashes, first windows, numbers of windows, the anchors' places in their bytes, and these."""
        g, run = (x.to_numpy() for x in batch.column("runs").flatten().flatten())
        own = np.repeat(np.arange(batch.num_rows), batch.column("runs").value_lengths().to_numpy())
        run, offset = np.divmod(run, length)
        first, more = np.divmod(run, length)
        texts = text_bytes(batch.column("text"))
        part = np.cumsum(more + length) // most
        ends = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [len(part) > 0]])) + 1
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
            s = slice(lo, hi)
            yield pa.array(own[s]), g[s], first[s], more[s] + 1, offset[s], [texts[i][a: b] for i, a, b in zip(own[s].tolist(), first[s].tolist(), (first + more + length)[s].tolist())]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for own, g, first, _, offset, cut in opened(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("h").take(own), *map(pa.array, (g, first, offset)), pa.array(cut, pa.binary())],
                                                 names=["id", "h", "g", "first", "offset", "bytes"])

    kinds = "id long, h long, g long, first long, offset long, bytes binary"
    marks = "id long, h long, first long, mask binary"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of g; a batch ends where g changes."""

        def solved(t: pa.Table) -> pa.RecordBatch:
            hits = repeated_starts(t["g"].to_numpy(), t["offset"].to_numpy(), t["bytes"].to_pylist(), length)
            use = [i for i, x in enumerate(hits) if x.any()]
            at = pa.array(use, pa.int64())
            mask = pa.array([np.packbits(hits[i]).tobytes() for i in use], pa.binary())
            pick = lambda c: t[c].take(at).combine_chunks()
            return pa.RecordBatch.from_arrays([pick("id"), pick("h"), pick("first"), mask], names=["id", "h", "first", "mask"])

        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < BATCH:
                continue
            g = held["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield solved(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solved(held)

    few = with_runs(False).mapInArrow(contexts, kinds).repartition("g").sortWithinPartitions("g").mapInArrow(compare, marks)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct windows of about WINDOWS ones with their count and one place."""

        def told(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            w, ids, hs, starts = (np.concatenate(x) for x in zip(*held))
            w, one, n = np.unique(w, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (w.view(np.int64), n, ids[one], hs[one], starts[one])], names=["w", "n", "id", "h", "start"])

        held, size = [], 0
        for batch in pieces(batches):
            ids, hs = (batch.column(c).to_numpy() for c in ("id", "h"))
            for own, g, first, n, _, cut in opened(batch):
                begins = np.cumsum([0, *map(len, cut[:-1])])
                run = np.repeat(np.arange(len(cut)), n)
                start = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                w = mix(rolling(np.frombuffer(b"".join(cut), np.uint8), length)[begins[run] + start] ^ mix(g.astype(np.uint64))[run])
                at = own.to_numpy()[run]
                held.append((w, ids[at], hs[at], first[run] + start))
                size += len(w)
                if size >= WINDOWS:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    once = with_runs(True).mapInArrow(windows, "w long, n long, id long, h long, start long").groupBy("w").agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "h", "start")).alias("x")).where("n = 1").select("x.id", "x.h", "x.start")
    # hot runs count as repeated but for the windows that come once; a row's stay one list
    hot_runs = lists.select("id", "h", F.transform(F.filter("runs", lambda r: r["hot"]), lambda r: r["run"]).alias("hot")).where(F.size("hot") > 0)
    none, no_hot = F.lit(None), F.lit(None).cast("array<long>").alias("hot")
    all_marks = few.select("id", "h", F.struct("first", "mask").alias("m"), no_hot).unionByName(
        once.select("id", "h", F.struct(F.col("start").alias("first"), none.cast("binary").alias("mask")).alias("m"), no_hot)).unionByName(
        hot_runs.select("id", "h", none.cast("struct<first:long,mask:binary>").alias("m"), "hot"))
    per_row = all_marks.repartition("id", "h").groupBy("id", "h").agg(F.collect_set("m").alias("marks"), F.first("hot", ignorenulls=True).alias("hot"))
    rows = on_key(per_row, "left").select("doc_id", "text", "marks", "hot")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out, own, hot = [], batch.column("marks"), batch.column("hot")
            ends, hot_ends = (np.cumsum(c.value_lengths().fill_null(0).to_numpy()).tolist() for c in (own, hot))
            firsts, masks = own.flatten().flatten()
            firsts, masked = firsts.to_numpy(), masks.is_valid().to_numpy(zero_copy_only=False)
            hots = hot.flatten().to_numpy()
            for i, t, lo, hi, a, b in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), [0, *ends[:-1]], ends, [0, *hot_ends[:-1]], hot_ends):
                first, is_mask = firsts[lo:hi], masked[lo:hi]
                start = np.zeros(max(0, len(t) - length + 1), bool)
                if b > a:
                    begin, more = np.divmod(hots[a:b] // length, length)
                    cover = np.zeros(len(start) + 1, np.int64)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + more + 1, -1)
                    start = np.cumsum(cover[:-1]) > 0
                for at in np.flatnonzero(is_mask).tolist():
                    bits = np.unpackbits(np.frombuffer(masks[lo + at].as_py(), np.uint8)).astype(bool)[: len(start) - first[at]]
                    start[first[at]: first[at] + len(bits)] |= bits
                start[first[~is_mask]] = False
                edge = np.zeros(len(t) + 1, np.int64)
                at = np.flatnonzero(start)
                edge[at] += 1
                edge[at + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(t, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((i, len(t), int(gone.sum()), spans, digest(left), left if keep_text else None))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text]
            if out:
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    return rows.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
