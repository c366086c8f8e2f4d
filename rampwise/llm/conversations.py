"""Repair of conversations: the cheapest edits that make the roles a well-formed dialogue.

Rows keep their turn's order. Roles' initials must read (s?(ua)+)?; an edit keeps a row (0), gives it the role user or assistant (2), deletes it
(3) or inserts an empty row of user or assistant (2). Blank and duplicate rows must go; a truncated row that stays costs 1.

The dynamic programme runs backwards over the rows with a vector of four costs, one for each state of the dialogue. Of these vectors only
those at about sqrt(n) checkpoints are stored; walking forwards, a block's vectors are made again from the checkpoint at its end, and at each step the
ASCII-least initial of D, I, K, R that is tight is taken. Vectors are kept less their minimum, of which there are few, so
a step is one look-up.

How it is dealt: rows are sorted by ranges of (conversation, turn, ...) and packed, where they stand, into pieces of at most `PIECE` rows, so a conversation with a third of all rows lies in
many tasks. A row is a duplicate if an earlier piece or place has its digest: the first place of a digest is an aggregate, and the rest is an anti join by place, which no hot text
can skew. The programme sees a byte for each row of a conversation, as long as the audit it returns in one cell; texts stay in their pieces, and a conversation's hash is
updated piece by piece.

Null roles and texts are one space. Null turns come first; rows of one turn go by the digest of their role and text. A null conversation is one conversation of its own. A
role without an initial, or with another than s, u and a, can't be kept as it is. A conversation without rows has zeros, an empty audit and the hash of the
empty string. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import stored

#: Rows and bytes of a piece.
PIECE, PIECE_BYTES = 1024, 4 << 20
WHITE = " \t\n\x0b\f\r"
TRUNCATED, BLANK, DUPLICATE = 4, 8, 16
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; where a user or assistant leads that may come next.
NEXT = (2, 2, 3, 2)
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of `conv_id:turn` names."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = (F.crc32(F.encode(name, "utf-8")) % 20).alias("kind")
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind).where("kind <> 0")
    base = base.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return base.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _codes(rows: DataFrame) -> DataFrame:
    """The rows with a digest of role and text and a code: initial, truncated, blank."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate("sua")], F.lit(3))
    ends = F.rtrim("text", F.lit(WHITE))
    blank = ends == ""
    cut = ~blank & ~F.right(ends, F.lit(1)).isin(".", "!", "?")
    digest = F.sha2(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256)
    base = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return base.select("conv_id", "turn", "role", "text", F.unhex(digest).alias("digest"), (initial + F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(0)).cast("int").alias("code"))


def pieces(rows: DataFrame) -> DataFrame:
    """Runs of at most PIECE rows of one conversation in order, packed: conv_id, k (which orders them), codes, roles, texts, digests."""
    kind = rows.schema["conv_id"].dataType
    coded = _codes(rows).withColumn("tie", F.monotonically_increasing_id())  # splits rows that are wholly equal
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "tie"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, held, size, conv, kind = TaskContext.get().partitionId() << 32, [], 0, None, None

        def out() -> pa.RecordBatch:
            code, role, text, digest = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], kind), pa.array([k], pa.int64()), pa.array([bytes(code)], pa.binary()), pa.array([role], pa.list_(pa.string())),
                 pa.array([text], pa.list_(pa.string())), pa.array([digest], pa.list_(pa.binary()))], names=["conv_id", "k", "codes", "roles", "texts", "digests"])

        for batch in batches:
            kind = batch.column("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "code", "role", "text", "digest")]
            for c, code, role, text, digest in zip(*columns):
                if held and (c != conv or len(held) == PIECE or size > PIECE_BYTES):
                    yield out()
                    k, held, size = k + 1, [], 0
                conv = c
                held.append((code, role, text, digest))
                size += len(role) + len(text)
        if held:
            yield out()

    from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

    schema = (StructType().add("conv_id", kind).add("k", LongType()).add("codes", BinaryType()).add("roles", ArrayType(StringType()))
              .add("texts", ArrayType(StringType())).add("digests", ArrayType(BinaryType())))
    return stored(ordered.select("conv_id", "code", "role", "text", "digest").mapInArrow(pack, schema), "conversation-pieces")


def repeated(table: DataFrame) -> DataFrame:
    """k and late: the places in a piece whose role and text an earlier row of the conversation has."""
    places = table.select("conv_id", "k", F.posexplode("digests").alias("i", "digest"))
    first = places.groupBy("conv_id", "digest").agg(F.min(F.struct("k", "i")).alias("x")).select("x.k", "x.i")
    return places.join(first, ["k", "i"], "left_anti").groupBy("k").agg(F.collect_list("i").alias("late"))


# --- the programme -------------------------------------------------------------------


def _moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: initial, cost, state after."""
    some = [("D", DELETE, state)]
    if not code & (BLANK | DUPLICATE):
        cut = CUT if code & TRUNCATED else 0
        initial = code & 3
        to = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(initial)
        if to is not None:
            some.append(("K", KEEP + cut, to))
        some.append(("R", REROLE + cut, NEXT[state]))
    return some


class Steps:
    """Steps of the programme, each remembered: vectors less their minimum are few."""

    def __init__(self) -> None:
        self.back: dict = {}
        self.ahead: dict = {}

    @staticmethod
    def costs(after: tuple, code: int) -> list[int]:
        cost = [min(c + after[t] for _, c, t in _moves(code, s)) for s in range(4)]
        for _ in range(3):  # inserted rows before this one
            cost = [min(cost[s], INSERT + cost[NEXT[s]]) for s in range(4)]
        return cost

    def before(self, after: tuple, code: int) -> tuple[tuple, int]:
        """The vector before a row, less its minimum, and that minimum."""
        found = self.back.get((after, code))
        if found is None:
            cost = self.costs(after, code)
            low = min(cost)
            found = self.back[after, code] = (tuple(c - low for c in cost), low)
        return found

    def edit(self, after: tuple, code: int, state: int) -> tuple[str, int]:
        """The ASCII-least tight edits up to and with this row, and the state after."""
        found = self.ahead.get((after, code, state))
        if found is None:
            cost, done, at = self.costs(after, code), "", state
            while found is None:
                tight = {x: t for x, c, t in _moves(code, at) if c + after[t] == cost[at]}
                if INSERT + cost[NEXT[at]] == cost[at]:
                    tight["I"] = NEXT[at]
                x = min(tight)
                done, at = done + x, tight[x]
                if x != "I":
                    found = self.ahead[after, code, state] = (done, at)
        return found


def repaired(codes: list[bytes], steps: Steps) -> tuple[list[tuple[int, list[str]]], int]:
    """For each piece the state before it and its rows' edits (the last piece with one entry more, for what follows its rows), and the cost."""
    every = b"".join(codes)
    n = len(every)
    step = max(1, math.isqrt(n))
    checkpoint, vector, cost = {n: END}, END, 0
    for i in range(n - 1, -1, -1):
        vector, low = steps.before(vector, every[i])
        cost += low
        if i % step == 0:
            checkpoint[i] = vector
    cost += vector[0]
    edits, states, state = [], [], 0
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        vectors = [checkpoint[hi]]
        for i in range(hi - 1, lo, -1):
            vectors.append(steps.before(vectors[-1], every[i])[0])
        for i in range(lo, hi):
            states.append(state)
            text, state = steps.edit(vectors[hi - 1 - i], every[i], state)
            edits.append(text)
    out, at = [], 0
    for c in codes:
        out.append((states[at] if len(c) else state, edits[at: at + len(c)]))
        at += len(c)
    out[-1][1].append({0: "", 3: "", 2: "I", 1: "II"}[state])
    return out, cost


def _by_conversation(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches as (conversation, values of `columns`)."""
    for batch in batches:
        yield from zip(batch.column("conv_id").to_pylist(), zip(*[batch.column(c).to_pylist() for c in columns]))


def _programme(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (conv_id, k, codes, late), sorted, to a row for each piece: its edits, the state before it, its counts."""
    steps, held, conv = Steps(), [], None

    def out() -> pa.RecordBatch:
        codes = []
        for _, code, late in held:
            x = bytearray(code)
            for i in late or ():
                x[i] |= DUPLICATE
            codes.append(bytes(x))
        found, cost = repaired(codes, steps)
        before, counts = None, []
        for c in codes:
            illegal = 0
            for x in c:
                illegal += before is not None and (before, x & 3) not in ((0, 1), (1, 2), (2, 1))
                before = x & 3
            counts.append((sum(x & BLANK > 0 for x in c), sum(x & (BLANK | DUPLICATE) == DUPLICATE for x in c), sum(x & (BLANK | DUPLICATE | TRUNCATED) == TRUNCATED for x in c), illegal))
        blank, duplicate, truncated, illegal = zip(*counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in held], pa.int64()), pa.array([s for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.string())),
             *[pa.array(x, pa.int64()) for x in (blank, duplicate, truncated, illegal, [cost] + [0] * (len(held) - 1))]],
            names=["k", "state", "edits", "blank", "duplicate", "truncated", "illegal", "cost"])

    for c, values in _by_conversation(batches, ["k", "codes", "late"]):
        if held and c != conv:
            yield out()
            held = []
        conv = c
        held.append(values)
    if held:
        yield out()


def lines(state: int, edits: list[str], roles: list[str], texts: list[str]) -> Iterator[str]:
    """The repaired rows of a piece as role:text."""
    for i, edit in enumerate(edits):
        for x in edit:
            if x == "D":
                continue
            to = {"s": 1, "u": 2, "a": 3}[roles[i][0]] if x == "K" else NEXT[state]
            role = roles[i] if x == "K" else "user" if to == 2 else "assistant"
            yield f"{role}:{'' if x == 'I' else texts[i]}"
            state = to


def _written(each: Callable) -> Callable:
    """Streams a conversation's pieces in order through `each` and returns one row for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        names = ["state", "edits", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "cost"]

        def out(conv, audit, counts, done):
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], kind), *[pa.array([x], pa.int64()) for x in counts], pa.array(["".join(audit)], pa.string()), pa.array([done()], pa.string())],
                names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])

        held = None
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, (state, edits, roles, texts, *n) in _by_conversation([batch], names):
                if held is not None and conv != held[0]:
                    yield out(*held[:3], held[3][1])
                    held = None
                if held is None:
                    held = (conv, [], [0] * 5, each())
                held[1].append("".join(edits))
                held[2][:] = [a + b for a, b in zip(held[2], n)]
                held[3][0](lines(state, edits, roles, texts))
        if held is not None:
            yield out(*held[:3], held[3][1])

    return run


def _hashed():
    """Takes lines, gives the hash of all of them joined by newlines; nothing is held."""
    h, some = hashlib.sha256(), []

    def take(new: Iterator[str]) -> None:
        for x in new:
            h.update(("\n" + x if some else x).encode())
            some[:] = [True]

    return take, h.hexdigest


def _joined():
    held: list[str] = []
    return held.extend, lambda: "\n".join(held)


def repair(rows: DataFrame, originals: DataFrame | None = None, texts: bool = False) -> DataFrame:
    """A row for each conversation of `originals` (`rows` by default): gaps, blank, duplicate, truncated, illegal, cost, audit, and repaired:
    the hash of the repaired rows, or with `texts` these rows themselves, which are then held whole for one conversation at a time."""
    table = pieces(rows)
    known = table.join(repeated(table), "k", "left")
    order = ["conv_id", "k"]
    told = known.select("conv_id", "k", "codes", "late").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _programme, "k long, state int, edits array<string>, blank long, duplicate long, truncated long, illegal long, cost long")
    told = stored(told, "conversation-edits")
    kind = rows.schema["conv_id"].dataType.simpleString()
    done = table.drop("codes", "digests").join(told, "k").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _written(_joined if texts else _hashed), f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string")
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("turns_of")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = (rows if originals is None else originals).groupBy(F.col("conv_id").alias("id")).agg(F.lit(1).alias("one")).select("id")
    found = every.join(done, every["id"].eqNullSafe(done["conv_id"]), "left").join(turns, every["id"].eqNullSafe(turns["turns_of"]), "left")
    empty = "" if texts else hashlib.sha256(b"").hexdigest()
    return found.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit(empty)).alias("repaired"))
