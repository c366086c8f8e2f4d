"""How many intervals of a key are open at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.functions.clock import micros
from rampwise.operators.frames import PAST, Measure, Running, instant_frames
from rampwise.operators.scan import tie_rank


def _intervals(df: DataFrame, key: str, start: str, end: str, id: str | None = None) -> DataFrame:
    # Only complete intervals: a lone end would lower the balance for ever.
    cols = [F.col(key).alias("key"), micros(df, start).alias("s"), micros(df, end).alias("e")]
    if id:
        cols.append(F.col(id).alias("id"))
    return df.select(*cols).where(F.col("key").isNotNull() & (F.col("s") < F.col("e")))


def _open_before(edges: DataFrame, asks: Column, form: str) -> DataFrame:
    """(key, t, open): balance at t after those that leave and before those that enter at t."""
    net = F.col("up") - F.col("down")
    run = instant_frames(edges, ["key"], "t", [Measure("up", F.col("up")), Measure("net", net)],
                         running=[Running("run", "net")], keep=["up"], asks=asks, form=form)
    return run.select("key", "t", (F.col("run") - F.col("up")).alias("open"))


def _edges(intervals: DataFrame) -> DataFrame:
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    pair = F.array(F.struct(F.col("s").alias("t"), one.alias("up"), none.alias("down")),
                   F.struct(F.col("e").alias("t"), none.alias("up"), one.alias("down")))
    return intervals.select("key", F.explode(pair).alias("x")).select("key", "x.t", "x.up", "x.down")


def occupancy(df: DataFrame, key: str, start: str, end: str, id: str, out: str = "occupancy",
              form: str = "scaled") -> DataFrame:
    """(id, out): open intervals of the key when the row's own interval starts, itself left out.

    At equal instants those that end leave first; simultaneous starts enter in order of `id`.
    """
    rows = _intervals(df, key, start, end, id)
    if form == "plain":
        stream = (rows.select("key", F.col("s").alias("t"), F.lit(1).alias("delta"), "id")
                  .unionByName(rows.select("key", F.col("e").alias("t"), F.lit(-1).alias("delta"),
                                           F.lit(None).cast(rows.schema["id"].dataType).alias("id"))))
        run = Window.partitionBy("key").orderBy("t", "delta", "id").rowsBetween(PAST, 0)
        return (stream.withColumn("q", F.sum("delta").over(run)).where(F.col("delta") == 1)
                .select(F.col("id").alias(id), (F.col("q") - 1).cast("long").alias(out)))
    state = _open_before(_edges(rows), F.col("up") > 0, form)
    ranked = tie_rank(rows.select("key", F.col("s").alias("t"), "id"), ["key", "t"], "id")
    return (ranked.join(state, ["key", "t"])
            .select(F.col("id").alias(id), (F.col("open") + F.col("tie_rank") - 1).cast("long").alias(out)))


def occupancy_at(probes: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str,
                 id: str, out: str = "occupancy", form: str = "scaled") -> DataFrame:
    """(id, out): open intervals at the probe's instant: leave, then probe, then enter."""
    held = _intervals(intervals, key, start, end)
    asked = probes.select(F.col(key).alias("key"), micros(probes, at).alias("t"), F.col(id).alias("id"))
    asked = asked.where(F.col("key").isNotNull() & F.col("t").isNotNull())
    if form == "plain":
        none = F.lit(None).cast(asked.schema["id"].dataType).alias("id")
        stream = (held.select("key", F.col("s").alias("t"), F.lit(1).alias("delta"), none)
                  .unionByName(held.select("key", F.col("e").alias("t"), F.lit(-1).alias("delta"), none))
                  .unionByName(asked.select("key", "t", F.lit(0).alias("delta"), "id")))
        run = Window.partitionBy("key").orderBy("t", "delta").rowsBetween(PAST, 0)
        return (stream.withColumn("q", F.sum("delta").over(run)).where(F.col("delta") == 0)
                .select(F.col("id").alias(id), F.col("q").cast("long").alias(out)))
    none = F.lit(0).cast("long")
    stream = (_edges(held).withColumn("ask", F.lit(False))
              .unionByName(asked.select("key", "t", none.alias("up"), none.alias("down"), F.lit(True).alias("ask"))))
    return (asked.join(_open_before(stream, F.col("ask"), form), ["key", "t"])
            .select(F.col("id").alias(id), F.col("open").cast("long").alias(out)))
