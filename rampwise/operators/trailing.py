"""Counts, means and extremes over trailing, preceding and centred frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.functions.clock import micros, slot_start, span
from rampwise.operators.frames import Frame, Measure, Running, count_where, instant_frames


def _minutes(seconds: float) -> str:
    return f"{seconds / 60:g}"


def _ask(probes: DataFrame, key: str, t: str, id: str) -> DataFrame:
    return probes.select(F.col(key).alias("key"), micros(probes, t).alias("t"), F.col(id).alias(id))


def trailing_counts(events: DataFrame, probes: DataFrame, key: str, t: str, kind: str,
                    kinds: Sequence[str], id: str, windows: Sequence[float] = (900, 1800, 3600),
                    probe_t: str | None = None, form: str = "scaled") -> DataFrame:
    """(id, <kind>_prev<minutes>): events of each kind in [t-window, t], read at the probes.

    Both ends are included, so events tied with the probe count; probes do not.
    """
    facts = events.select(F.col(key).alias("key"), micros(events, t).alias("t"), F.col(kind).alias("kind"),
                          F.lit(False).alias("ask"))
    asked = _ask(probes, key, probe_t or t, id)
    stream = facts.unionByName(asked.select("key", "t", F.lit(None).cast("string").alias("kind"),
                                            F.lit(True).alias("ask")))
    measures = [Measure(f"n_{k}", count_where(F.col("kind") == k)) for k in kinds]
    frames = [Frame(f"{k}_prev{_minutes(w)}", f"n_{k}", -span(w), 0) for k in kinds for w in windows]
    found = instant_frames(stream, ["key"], "t", measures, frames, asks=F.col("ask"), form=form)
    return (asked.where(F.col("t").isNotNull()).join(found, ["key", "t"])
            .select(id, *[F.coalesce(f.out, F.lit(0)).cast("long").alias(f.out) for f in frames]))


def trailing_means(events: DataFrame, probes: DataFrame, key: str, t: str, kind: str, value: str,
                   kinds: Sequence[str], id: str, window: float = 3600, gap: float = 1,
                   probe_t: str | None = None, form: str = "scaled") -> DataFrame:
    """(id, <kind>_mean<minutes>): mean over [t-window, t-gap]; null if nothing is there."""
    facts = events.select(F.col(key).alias("key"), micros(events, t).alias("t"), F.col(kind).alias("kind"),
                          F.col(value).cast("double").alias("v"), F.lit(False).alias("ask"))
    asked = _ask(probes, key, probe_t or t, id)
    stream = facts.unionByName(asked.select(
        "key", "t", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("v"),
        F.lit(True).alias("ask")))
    measures, frames = [], []
    for k in kinds:
        held = (F.col("kind") == k) & F.col("v").isNotNull()
        measures += [Measure(f"n_{k}", count_where(held)), Measure(f"s_{k}", F.when(held, F.col("v")))]
        frames += [Frame(f"fn_{k}", f"n_{k}", -span(window), -span(gap)),
                   Frame(f"fs_{k}", f"s_{k}", -span(window), -span(gap))]
    found = instant_frames(stream, ["key"], "t", measures, frames, asks=F.col("ask"), form=form)
    return (asked.where(F.col("t").isNotNull()).join(found, ["key", "t"])
            .select(id, *[F.try_divide(F.col(f"fs_{k}"), F.col(f"fn_{k}")).alias(f"{k}_mean{_minutes(window)}")
                          for k in kinds]))


def nowcast(df: DataFrame, key: str, t: str, values: Sequence[str], id: str,
            windows: Sequence[float] = (3600, 10800), gap: float = 1, form: str = "scaled") -> DataFrame:
    """Means of the *other* recent rows of the same stream.

    (id, <v>_mean<m>, <v>_absmean<m>, n<m>) over [t-window, t-gap].  Rows that lack the time or
    any value are outside the stream: not counted and without a result.
    """
    rows = df.select(F.col(key).alias("key"), micros(df, t).alias("t"), F.col(id).alias(id),
                     *[F.col(v).cast("double").alias(v) for v in values])
    for c in ("key", "t", *values):
        rows = rows.where(F.col(c).isNotNull())
    measures = [Measure("n", F.lit(1).cast("long"))]
    frames = [Frame(f"n{_minutes(w)}", "n", -span(w), -span(gap)) for w in windows]
    for v in values:
        measures += [Measure(f"s_{v}", F.col(v)), Measure(f"a_{v}", F.abs(F.col(v)))]
        frames += [Frame(f"{p}_{v}_{_minutes(w)}", f"{p}_{v}", -span(w), -span(gap))
                   for p in ("s", "a") for w in windows]
    found = instant_frames(rows, ["key"], "t", measures, frames, form=form)
    made = []
    for w in map(_minutes, windows):
        n = F.col(f"n{w}")
        made.append(F.coalesce(n, F.lit(0)).cast("long").alias(f"n{w}"))
        for v in values:
            made.append(F.try_divide(F.col(f"s_{v}_{w}"), n).alias(f"{v}_mean{w}"))
            made.append(F.try_divide(F.col(f"a_{v}_{w}"), n).alias(f"{v}_absmean{w}"))
    return rows.select("key", "t", id).join(found, ["key", "t"]).select(id, *made)


def centred_count(df: DataFrame, key: str, t: str, id: str, before: float = 1800, after: float = 1800,
                  out: str = "around", form: str = "scaled") -> DataFrame:
    """(id, out): rows of the key within [t-before, t+after], the row itself included."""
    rows = _ask(df, key, t, id).where(F.col("t").isNotNull())
    found = instant_frames(rows, ["key"], "t", [Measure("n", F.lit(1).cast("long"))],
                           [Frame(out, "n", -span(before), span(after))], form=form)
    return rows.join(found, ["key", "t"]).select(id, F.col(out).cast("long").alias(out))


def bucket_totals(df: DataFrame, key: str, t: str, value: str, width: float = 3600,
                  where: Column | None = None) -> DataFrame:
    """(key, bucket, total, n) per slot of time; `bucket` is its start in microseconds."""
    rows = df if where is None else df.where(where)
    return (rows.where(F.col(t).isNotNull())
            .groupBy(F.col(key).alias(key), slot_start(micros(rows, t), span(width)).alias("bucket"))
            .agg(F.sum(F.col(value).cast("double")).alias("total"), F.count(F.lit(1)).alias("n")))


def prev_buckets(totals: DataFrame, key: str, n: int = 6, width: float = 3600,
                 bucket: str = "bucket") -> DataFrame:
    """Adds total_prev and n_prev: the `n` buckets before, the current one left out.

    The input already holds one row per key and bucket, so a key's group is the
    number of buckets in the data's time span.
    """
    frame = Window.partitionBy(key).orderBy(bucket).rangeBetween(-n * span(width), -span(width))
    return totals.select("*", F.sum("total").over(frame).alias("total_prev"),
                         F.sum("n").over(frame).alias("n_prev"))


def leave_own_bucket_out(totals: DataFrame, key: str, coarse: float = 86400,
                         bucket: str = "bucket") -> DataFrame:
    """Mean of the coarse bucket without the fine one: (C-f)/(nC-nf), null where nothing remains."""
    fine = totals.withColumn("coarse", slot_start(bucket, span(coarse)))
    whole = fine.groupBy(key, "coarse").agg(F.sum("total").alias("_total"), F.sum("n").alias("_n"))
    left = F.col("_n") - F.col("n")
    return (fine.join(whole, [key, "coarse"])
            .select(*totals.columns, "coarse",
                    F.when(left != 0, (F.col("_total") - F.col("total")) / left).alias("rest_mean"),
                    left.alias("rest_n")))


def rolling(df: DataFrame, key: str, t: str, specs: Mapping[str, tuple[str, Column, float]],
            form: str = "scaled") -> DataFrame:
    """(key, t, one column per spec): name -> (how, value, seconds) over [t-seconds, t].

    `how` is sum, min, max or avg on an irregular series; nulls are skipped.
    """
    rows = df.withColumn("_t", micros(df, t))
    measures, frames = [], []
    for name, (how, value, seconds) in specs.items():
        if how == "avg":
            measures += [Measure(f"s_{name}", value.cast("double")), Measure(f"n_{name}", count_where(value.isNotNull()))]
            frames += [Frame(f"{p}f_{name}", f"{p}_{name}", -span(seconds), 0) for p in ("s", "n")]
        else:
            measures.append(Measure(f"m_{name}", value, how))
            frames.append(Frame(name, f"m_{name}", -span(seconds), 0))
    found = instant_frames(rows, [key], "_t", measures, frames, form=form)
    made = [F.try_divide(F.col(f"sf_{n}"), F.col(f"nf_{n}")).alias(n) if how == "avg" else F.col(n)
            for n, (how, _, _) in specs.items()]
    return found.select(key, F.col("_t").alias("t_us"), *made)


def last_when(df: DataFrame, key: str, t: str, condition: Column, out: str = "last_t",
              form: str = "scaled") -> DataFrame:
    """(key, t_us, out): last instant at or before t at which the condition held, in microseconds."""
    rows = df.withColumn("t_us", micros(df, t)).where(F.col("t_us").isNotNull() & F.col(key).isNotNull())
    held = Measure("held", F.when(condition, F.col("t_us")), "max")
    return instant_frames(rows, [key], "t_us", [held], running=[Running(out, "held")], form=form)
