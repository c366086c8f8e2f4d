"""Runs of consecutive points at one site, and what happened in and after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.functions.scalars import planar_metres
from rampwise.operators import asof
from rampwise.operators.scan import neighbours, running_sums

ORDER = ("t", "seq")


def _slot(block: float) -> Column:
    return F.floor(F.col("t") / block).cast("long")


def with_step(points: DataFrame, entity: str = "entity", block: float = 3600) -> DataFrame:
    """Each point with the points before and after it (structs prev and next).

    Points have: entity, t (epoch seconds), seq, ground, site (null off-site), lat, lon, gs.
    """
    blocked = points.withColumn("_blk", _slot(block))
    return neighbours(blocked, [entity], "_blk", list(ORDER), ["t", "seq", "ground", "site", "lat", "lon", "gs"])


def segments(points: DataFrame, entity: str = "entity", max_gap: float = 1800, block: float = 3600) -> DataFrame:
    """The points on ground at a site, with the number `seg` of their run within the entity and
    whether they continue it (`inside`).

    A run goes on while the immediately previous point was on ground at the same site at most
    `max_gap` seconds before; an airborne or off-site point ends it.
    """
    stepped = with_step(points, entity, block)
    here = F.coalesce("ground", F.lit(False)) & F.col("site").isNotNull()
    goes_on = (F.col("prev.ground") & (F.col("prev.site") == F.col("site"))
               & (F.col("t") - F.col("prev.t") <= max_gap))
    opens = F.when(here & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0).cast("long")
    numbered = running_sums(stepped.withColumn("opens", opens), [entity], "_blk", list(ORDER), ["opens"], "seg_")
    return (numbered.where(here).withColumn("inside", F.col("opens") == 0)
            .withColumnRenamed("seg_opens", "seg").drop("opens", "_blk"))


def summarise(runs: DataFrame, entity: str = "entity", moving: float = 3, min_points: int = 2) -> DataFrame:
    """One row per run of at least `min_points`: first, first moving and last point, and count."""
    rank = F.struct(*ORDER)
    at = lambda c: F.min_by(c, rank)
    fast = F.coalesce("gs", F.lit(0.0)) >= moving
    first_fast = lambda c: F.min_by(F.when(fast, F.col(c)), F.when(fast, rank))
    end = lambda c: F.max_by(c, rank)
    return (runs.groupBy(entity, "seg").agg(
        at("site").alias("site"), F.count(F.lit(1)).alias("n_ground"), at("t").alias("t_first_ground"),
        first_fast("t").alias("t_first_moving"), end("t").alias("t_last_ground"), at("lat").alias("lat0"),
        at("lon").alias("lon0"), at("gs").alias("gs_first"), end("lat").alias("lat_last"), end("lon").alias("lon_last"),
        first_fast("lat").alias("lat_moving"), first_fast("lon").alias("lon_moving"),
        end("next").alias("after"), end("seq").alias("seq_last"),
        *[at(c).alias(f"{c}_first") for c in ("track", "stale") if c in runs.columns])
        .where(F.col("n_ground") >= min_points))


def next_after(summary: DataFrame, within: float = 1200) -> DataFrame:
    """Adds t_first_air: the point right after the run, if airborne and not too late."""
    lifted = ~F.coalesce("after.ground", F.lit(False)) & (F.col("after.t") - F.col("t_last_ground") <= within)
    return summary.withColumn("t_first_air", F.when(lifted, F.col("after.t"))).drop("after")


def motion(runs: DataFrame, entity: str = "entity", moving: float = 3, stopped: float = 1, max_step: float = 300) -> DataFrame:
    """(entity, seg, path_m, stopped_s, n_stops, max_gs) from the first moving point on.

    The step into that point counts; steps over `max_step` seconds do not.  Time is stopped when
    both ends are below `stopped`; a stop is a point below it right after a moving one.
    """
    gs = F.coalesce("gs", F.lit(0.0))
    begun = runs.groupBy(entity, "seg").agg(F.min(F.when(gs >= moving, F.col("t"))).alias("_from"))
    rows = runs.join(begun, [entity, "seg"])
    on = F.coalesce(F.col("t") >= F.col("_from"), F.lit(False))
    dt = F.col("t") - F.col("prev.t")
    step = on & F.col("inside") & (dt > 0) & (dt <= max_step)
    was = F.coalesce("prev.gs", F.lit(0.0))
    metres = planar_metres("lat", "lon", "prev.lat", "prev.lon")
    return rows.groupBy(entity, "seg").agg(
        F.sum(F.when(step, metres).otherwise(0.0)).alias("path_m"),
        F.sum(F.when(step & (gs < stopped) & (was < stopped), dt).otherwise(0.0)).cast("double").alias("stopped_s"),
        F.count_if(on & F.col("inside") & (gs < stopped) & (was >= moving)).alias("n_stops"),
        F.greatest(F.lit(0.0), F.max(F.when(on, gs).otherwise(0.0))).alias("max_gs"))


def later_name(rows: DataFrame, points: DataFrame, entity: str = "entity", at: str = "t", name: str = "callsign") -> DataFrame:
    """`rows` plus `later`: the first name a point carries strictly after `at`."""
    # Of names at one instant the one of the smallest seq is heard first.
    named = points.where(F.col(name).isNotNull()).select(
        entity, F.col("t").alias("_pt"), (-F.col("seq")).alias("_first"), F.col(name).alias("later"))
    return asof.next_after(rows, named, [entity], at, "_pt", ["_first", "later"]).drop("next_t", "_first")


def run_names(runs: DataFrame, summary: DataFrame, points: DataFrame, entity: str = "entity", name: str = "callsign") -> DataFrame:
    """(entity, seg, name): the commonest name in the run, the first seen on a tie.

    A run without a lift-off adds the next name heard after it to the tally.
    """
    seen = (runs.where(F.col(name).isNotNull()).groupBy(entity, "seg", name)
            .agg(F.count(F.lit(1)).alias("n"), F.min("t").cast("double").alias("first")))
    after = later_name(summary.where(F.col("t_first_air").isNull()).select(entity, "seg", "t_last_ground"), points,
                       entity, "t_last_ground", name)
    added = (after.where(F.col("later").isNotNull())
             .select(entity, "seg", F.col("later").alias(name), F.lit(1).cast("long").alias("n"),
                     F.lit(float("inf")).alias("first")))
    tally = (seen.unionByName(added).groupBy(entity, "seg", name)
             .agg(F.sum("n").alias("n"), F.min("first").alias("first")))
    return tally.groupBy(entity, "seg").agg(F.max_by(name, F.struct(F.col("n"), -F.col("first"))).alias(name))
