"""Time frames and running values, evaluated once per distinct instant.

Rows of one key that share an instant share every RANGE frame and every running value.  The
stream is therefore reduced to one row per (key, instant) first, with partial aggregation before
the shuffle; windows then run per (key, slot of time) over instants, and the result is joined to
the rows that asked.  A window group holds at most the instants of two or three slots, however
many rows a key, a slot or an instant has.

A frame is the end of one slot and the beginning of the next, so instants are copied there; both parts only ever
grow by a row, so a frame costs the same whether it holds ten instants or ten million.  A running value is climbed on a ladder: the
instants of its minute, the minutes of its day before that, and the days before; no group of a ladder holds more than
the instants of a minute, 1,440 minutes, or a row for each day.

Three forms give the same result.  `scaled` is the above.  `fine` is for frames over streams in which one slot may
hold too many distinct instants (clocks of a microsecond): it splits a frame into the part of its first
second, the whole seconds between and the part of its last one, so that no group exceeds the instants of
a second or the seconds of three slots, whatever the data.  `plain` is one group per key, to compare with.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.functions.clock import DAY, HOUR, MINUTE, SECOND, micros, slot_start

COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}
PAST = Window.unboundedPreceding


@dataclass(frozen=True)
class Measure:
    """A partial value per instant: `how` merges rows, and instants of a frame."""

    name: str
    column: Column
    how: str = "sum"


@dataclass(frozen=True)
class Frame:
    """`measure` over instants from t+low to t+high microseconds, both included."""

    out: str
    measure: str
    low: int
    high: int


@dataclass(frozen=True)
class Running:
    """`measure` over all instants up to t, with or without t itself.

    The largest of structs that start with their time is the latest one: an as-of search.
    """

    out: str
    measure: str
    exclusive: bool = False


def count_where(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _merge(how: str, earlier: Column, here: Column) -> Column:
    if how == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0))
    if how == "max":  # here is never below earlier where both orders are by time
        return F.coalesce(F.greatest(earlier, here), earlier, here)
    return F.coalesce(F.least(earlier, here), earlier, here)


def instant_frames(stream: DataFrame, keys: Sequence[str], t: str, measures: Sequence[Measure],
                   frames: Sequence[Frame] = (), running: Sequence[Running] = (), keep: Sequence[str] = (),
                   asks: Column | None = None, form: str = "scaled", slot: int = MINUTE) -> DataFrame:
    """(keys, t, frames, running values, kept measures), a row per instant where `asks` holds for some row.

    A measure's column is evaluated per stream row; null contributes nothing.  `slot` is the slot's width
    where no frame sets it.
    """
    if form not in ("plain", "scaled", "fine"):
        raise ValueError(f"unknown form {form}")
    asked = F.lit(True) if asks is None else asks
    rows = stream.where(F.col(t).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    how = {m.name: m.how for m in measures}
    instants = rows.groupBy(*keys, t).agg(*[COMBINE[m.how](m.column).alias(m.name) for m in measures],
                                          F.max(asked).alias("_asked"))
    if frames and form != "plain":
        out = (_by_seconds(instants, keys, t, measures, frames) if form == "fine" else _by_slots(instants, keys, t, frames, how))
        if running or keep:
            rest = instant_frames(stream, keys, t, measures, (), running, keep, asks, slot=slot)
            out = out.join(rest, [*keys, t])
        return out.select(*keys, t, *keep, *[f.out for f in frames], *[r.out for r in running])
    if form == "plain":
        group = Window.partitionBy(*keys).orderBy(t)
        made = [COMBINE[how[f.measure]](f.measure).over(group.rangeBetween(f.low, f.high)).alias(f.out) for f in frames]
    else:
        group, made = Window.partitionBy(*keys, "_slot").orderBy(t), []
        instants = instants.withColumn("_slot", slot_start(t, slot))
    made += [COMBINE[how[r.measure]](r.measure).over(group.rowsBetween(PAST, -1 if r.exclusive else 0)).alias(r.out) for r in running]
    spot = [] if form == "plain" else ["_slot"]
    out = instants.select(*keys, t, *spot, "_asked", *keep, *made).where("_asked")
    if running and form != "plain":
        # The totals read the same columns as the instants and share their exchange.
        used = sorted({r.measure for r in running})
        totals = instants.groupBy(*keys, "_slot").agg(*[COMBINE[how[m]](m).alias(m) for m in used], F.max("_asked").alias("_asked"))
        before = _earlier(totals, keys, used, how)
        # A left join infers no null filter on its left side, so the two readers of the instants stay alike.
        out = out.join(before, [*keys, "_slot"], "left")
        out = out.select(*keys, t, *keep, *[_merge(how[r.measure], F.col(f"_b_{r.measure}"), F.col(r.out)).alias(r.out) for r in running])
    return out.select(*keys, t, *keep, *[f.out for f in frames], *[r.out for r in running])


def _by_slots(instants: DataFrame, keys: Sequence[str], t: str, frames: Sequence[Frame], how: dict[str, str]) -> DataFrame:
    """Frames of the asked instants as the end of one slot and the beginning of the next.

    Slots are as wide as the frame, so a frame that ends in a slot begins in the one before. Both parts run from an end of their own order: each
    row adds to a value and none is computed anew, however many instants a frame holds. Frames of other bounds have slots of their own.
    """
    out = None
    for low, high in sorted({(f.low, f.high) for f in frames}):
        own = [f for f in frames if (f.low, f.high) == (low, high)]
        used, width = sorted({f.measure for f in own}), max(high - low, 1)
        home, ends = slot_start(t, width), slot_start(F.col(t) + F.lit(high), width)
        spots = F.array(home, home + F.lit(width)) if high == 0 else F.array_distinct(F.array(home, home + F.lit(width), F.when(F.col("_asked"), ends).otherwise(home)))
        placed = instants.select(*keys, t, "_asked", *used, F.explode(spots).alias("_slot"))
        group = Window.partitionBy(*keys, "_slot")
        until, since = group.orderBy(F.asc(t)).rangeBetween(PAST, high), group.orderBy(F.desc(t)).rangeBetween(PAST, -low)
        part = lambda m, at, frame: COMBINE[how[m]](F.when(F.col("_slot") == at, F.col(m))).over(frame)
        parts = [made for m in used for made in (part(m, home + F.lit(width), since).alias(f"_a_{m}"), part(m, home, until).alias(f"_z_{m}"))]
        found = (placed.select(*keys, t, (F.col("_asked") & (F.col("_slot") == ends)).alias("_here"), *parts).where("_here")
                 .select(*keys, t, *[_all_of(how[f.measure], [F.col(f"_a_{f.measure}"), F.col(f"_z_{f.measure}")]).alias(f.out) for f in own]))
        out = found if out is None else out.join(found, [*keys, t])
    return out


def _earlier(totals: DataFrame, keys: Sequence[str], used: Sequence[str], how: dict[str, str]) -> DataFrame:
    """(keys, _slot, _b_ of each measure): what all slots before hold, for the slots that ask.

    A ladder of two steps: the slots of the same day, at most 1,440 minutes in a group, and the days before, one row each.
    """
    days = totals.withColumn("_day", slot_start("_slot", DAY))
    in_day, over_days = (Window.partitionBy(*p).orderBy(o).rowsBetween(PAST, -1) for p, o in (((*keys, "_day"), "_slot"), (keys, "_day")))
    low = days.select(*keys, "_day", "_slot", "_asked", *[COMBINE[how[m]](m).over(in_day).alias(f"_l_{m}") for m in used]).where("_asked").drop("_asked")
    high = (days.groupBy(*keys, "_day").agg(*[COMBINE[how[m]](m).alias(m) for m in used], F.max("_asked").alias("_asked"))
            .select(*keys, "_day", "_asked", *[COMBINE[how[m]](m).over(over_days).alias(f"_h_{m}") for m in used]).where("_asked").drop("_asked"))
    return low.join(high, [*keys, "_day"], "left").select(*keys, "_slot", *[_merge(how[m], F.col(f"_h_{m}"), F.col(f"_l_{m}")).alias(f"_b_{m}") for m in used])


def _all_of(how: str, parts: Sequence[Column]) -> Column:
    """Parts of one frame put together; null where all are."""
    if how != "sum":
        return (F.least if how == "min" else F.greatest)(*parts)
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))


def _by_seconds(instants: DataFrame, keys: Sequence[str], t: str, measures: Sequence[Measure], frames: Sequence[Frame],
                tick: int = SECOND) -> DataFrame:
    """Frames of the asked instants as first part, whole ticks and last part."""
    if any(f.low % tick or f.high % tick or f.low >= f.high for f in frames):
        raise ValueError("frame bounds must be different whole seconds")
    how = {m.name: m.how for m in measures}
    names = [m.name for m in measures]
    edges = sorted({(f.low, "from") for f in frames} | {(f.high, "to") for f in frames})
    # Marks stand where a frame of an asked instant begins or ends.
    marks = instants.where("_asked").select(*keys, F.col(t).alias("_of"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("edge"), (F.col(t) + F.lit(o)).alias("at")) for i, (o, _) in enumerate(edges)])).alias("m"))
    marks = marks.select(*keys, F.col("m.at").alias("_at"), "_of", F.col("m.edge").alias("_edge"),
                         *[F.lit(None).cast(instants.schema[n].dataType).alias(n) for n in names])
    facts = instants.select(*keys, F.col(t).alias("_at"), F.lit(None).cast("long").alias("_of"), F.lit(None).cast("int").alias("_edge"), *names)
    # Both directions run from the start of their own order, so each row adds to a sum and none is computed anew.
    group = Window.partitionBy(*keys, "_tick")
    until, since = (group.orderBy(o).rangeBetween(PAST, 0) for o in (F.asc("_at"), F.desc("_at")))
    seen = facts.unionByName(marks).withColumn("_tick", slot_start("_at", tick)).select(
        *keys, "_of", "_edge",
        *[COMBINE[how[n]](n).over(until).alias(f"_to_{n}") for n in sorted({f.measure for f in frames})],
        *[COMBINE[how[n]](n).over(since).alias(f"_from_{n}") for n in sorted({f.measure for f in frames})]).where(F.col("_edge").isNotNull())
    place = {e: i for i, e in enumerate(edges)}
    part = lambda f, side, o: F.max(F.when(F.col("_edge") == place[(o, side)], F.col(f"_{side}_{f.measure}")))
    ends = seen.groupBy(*keys, F.col("_of").alias(t)).agg(*[
        made for f in frames for made in (part(f, "from", f.low).alias(f"_a_{f.out}"), part(f, "to", f.high).alias(f"_z_{f.out}"))])
    inner = [Frame(f"_i_{f.out}", f.measure, f.low + tick, f.high - tick) for f in frames if f.low + tick <= f.high - tick]
    if inner:
        between = instant_frames(instants.withColumn("_tick", slot_start(t, tick)), keys, "_tick",
                                 [Measure(m.name, F.col(m.name), m.how) for m in measures], inner, asks=F.col("_asked"))
        ends = ends.withColumn("_tick", slot_start(t, tick)).join(between, [*keys, "_tick"])
    middle = {f.out for f in inner}
    return ends.select(*keys, t, *[
        _all_of(how[f.measure], [F.col(f"_a_{o}"), *([F.col(f"_i_{o}")] if f"_i_{o}" in middle else []), F.col(f"_z_{o}")]).alias(o)
        for f in frames for o in [f.out]])
