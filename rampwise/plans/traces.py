"""From trace documents to ground segments, and from segments to departure features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.functions import scalars as S
from rampwise.operators import groups, match, occupancy, segments, setops, trailing
from rampwise.operators.quantiles import medians
from rampwise.operators.sites import site_join
from rampwise.session import pinned, written
from rampwise.sources.traces import explode_points

SCHEMA_VERSION = 3
#: Half the height and width of a site's box in degrees.
BOX = (0.06, 0.09)
OPTIONAL = {"path_m": "double", "stopped_s": "double", "n_stops": "bigint", "max_gs": "double",
            "actype": "string", "reg": "string"}
#: What `trace_features` and `surface_features` make, by what a segment has to tell for it, and which of it needs a reference start of the row's own.
FEATURES = {
    "trace": ("day_covered", "present", "match_kind", "taxi_moving", "taxi_firstobs", "moving_vs_ref", "firstobs_vs_ref", "wait_before_moving", "n_ground"),
    "trace_position": ("dist_stand_m", "gs_first"),
    "trace_motion": ("path_m", "stopped_s", "n_stops", "max_gs", "mean_speed"),
    "trace_surface": ("moving_now", "lifted_prev15"),
}
OWN_START = tuple(c for c in FEATURES["trace"] if c.endswith("_vs_ref"))


def ground_segments(points: DataFrame, sites: Mapping[str, tuple[float, float]] | DataFrame | None = None, entity: str = "entity",
                    max_gap: float = 1800, within: float = 1200, moving: float = 3, box: tuple[float, float] = BOX) -> DataFrame:
    """One row per run on ground: times, positions, callsign, movement along the surface.

    `points` come from `explode_points` with an `entity` (an aircraft, or an aircraft and day);
    the site is looked up from `sites` (a few by name, or a table as `site_join` takes it) or taken from a column of that name.
    """
    if isinstance(sites, DataFrame):
        points = site_join(points, sites, *box)
    elif sites is not None:
        points = points.withColumn("site", S.site_of("lat", "lon", sites, *box))
    # Four aggregates read the runs: they are cut from the trace scan and its windows once.
    runs = pinned(segments.segments(points, entity, max_gap))
    summary = segments.next_after(segments.summarise(runs, entity, moving), within)
    moved = segments.motion(runs, entity, moving)
    names = segments.run_names(runs, summary, points, entity)
    return (summary.join(moved, [entity, "seg"], "left").join(names, [entity, "seg"], "left")
            .withColumn("schema", F.lit(SCHEMA_VERSION)).drop("seq_last"))


def segments_of_documents(docs: DataFrame, sites: Mapping[str, tuple[float, float]] | DataFrame | None = None, **options) -> DataFrame:
    """From trace documents (path, doc) to ground segments with the aircraft's hex, actype and reg and a `seg_id`.

    A document is an entity: runs never go on from one into the next. Documents that could not be read have no points.
    """
    points = explode_points(docs.where(F.col("doc").isNotNull()), keep=("path",)).withColumnRenamed("path", "entity")
    # The windows of the runs, the later names and the craft read the points: documents are read and parsed once.
    points = written(points, "points")
    craft = points.groupBy("entity").agg(*[F.max(c).alias(c) for c in ("hex", "actype", "reg")])
    runs = ground_segments(points, sites, **options).join(craft, "entity", "left")
    return runs.withColumn("seg_id", F.concat_ws("#", "entity", F.col("seg").cast("string")))


def departures_to_match(raw: DataFrame) -> DataFrame:
    """Raw movements to the departures that `match_traces` reads: normalised callsign and flight number, times in epoch seconds, and the day."""
    secs = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    off = secs("MVT_TIME_UTC_mvt")
    return raw.where(F.col("PHASE_mvt") == "DEP").select(
        F.col("MVT_ID_mvt").alias("id"), F.col("ADEP_mvt").alias("site"), key_text("CALLSIGN_flt").alias("cs"), key_text("FLIGHT_mvt").alias("flt"),
        F.col("STAND_mvt").alias("stand"), off.alias("t_off"), secs("AOBT_3_flt").alias("t_ref"), secs("BLOCK_TIME_UTC_mvt").alias("t_start"),
        secs("SCHED_TIME_UTC_mvt").alias("t_sched"), F.col("TAXITIME_SEC_mvt").cast("double").alias("y"), F.floor(off / 86_400).cast("long").alias("day"))


def key_text(name: str):
    """Upper case without blanks around; an empty one is none."""
    return F.nullif(S.normalise(name), F.lit(""))


def prefix_map(dep: DataFrame) -> DataFrame:
    """(ia, ic): designator of the flight number to the callsign prefix most often seen with it."""
    coded = dep.select(S.key_part("flt", S.DESIGNATOR).alias("ia"), S.key_part("cs", S.ALPHA_PREFIX).alias("ic"))
    return groups.learn_code_map(coded, "ia", "ic")


def with_guesses(dep: DataFrame, literal_fallback: bool = True, learn_from: DataFrame | None = None) -> DataFrame:
    """Adds ic (prefix) and cs_guess, by prefixes learned from `learn_from` or from `dep` itself.

    An extraction without a match is '' and not null, so with `literal_fallback` the flight number's
    own prefix is only used where there is no callsign at all.
    """
    pm = prefix_map(dep if learn_from is None else learn_from).withColumnRenamed("ic", "_ic")
    own, from_flight = S.key_part("cs", S.ALPHA_PREFIX), S.key_part("flt", S.ALPHA_PREFIX)
    if not literal_fallback:
        own = F.nullif(own, F.lit(""))
    joined = dep.withColumn("ia", S.key_part("flt", S.DESIGNATOR)).join(pm, "ia", "left")
    return joined.select(*[dep[c] for c in dep.columns], F.coalesce("_ic", own, from_flight).alias("ic"),
                         S.guessed_key("_ic", "flt").alias("cs_guess"))


def match_traces(dep: DataFrame, seg: DataFrame, tol: float = 180, after: float = 360, near: float = 90,
                 width: float = 600, learn_from: DataFrame | None = None) -> DataFrame:
    """The accepted segment of each departure.

    Departures: id, site, cs, flt, t_off; callsigns and numbers are normalised on both sides. Segments: seg_id, site, callsign, t_first_air, t_last_ground
    and whatever is to be carried, a row for each seg_id. The joins and the choice carry ids and times only; a segment's other columns
    are brought to the accepted pairs once. Kinds: 1 callsign, 2 flight number as callsign, 3 guessed callsign,
    4 prefix and lift-off within `near` seconds, accepted only if it is the only one.
    """
    clean = lambda df: df.withColumns({c: key_text(c) for c in ("cs", "flt")})
    known = with_guesses(clean(dep), learn_from=None if learn_from is None else clean(learn_from)).select("id", "site", "cs", "flt", "cs_guess", "ic", "t_off")
    held = seg.select("seg_id", "site", "t_first_air", "t_last_ground", S.normalise("callsign").alias("seg_cs")).where(F.col("seg_cs").isNotNull())
    anchor = F.coalesce("t_first_air", "t_last_ground")
    exact = match.match_any_key(known, held, [("cs", 1), ("flt", 2), ("cs_guess", 3)], "seg_cs", ["site"],
                                "t_off", anchor, max(width, tol, after), max(tol, after))
    exact = match.within_reach(exact, "t_off", "t_first_air", "t_last_ground", tol, after)
    by_prefix = match.match_bucketed(
        known.where(F.col("ic") != ""), held.withColumn("ic", S.key_part("seg_cs", S.ALPHA_PREFIX)), ["site", "ic"],
        "t_off", "t_first_air", near, width)
    by_prefix = setops.without(by_prefix, exact, ["id", "seg_id"])
    keep = ["id", "seg_id", "kind", "dist"]
    best = match.accept(exact.select(keep).unionByName(by_prefix.select(keep)), "id", "seg_id")
    return best.join(seg.drop("site"), "seg_id").select("id", *[c for c in seg.columns if c != "site"], "kind", "dist")


def stand_distance(matched: DataFrame, dep: DataFrame, min_n: int = 5) -> DataFrame:
    """(id, dist_stand_m): from where the trace was first heard to the stand's learned position."""
    placed = matched.select("id", "kind", "gs_first", "lat0", "lon0").join(dep.select("id", "site", "stand"), "id")
    still = (F.col("kind") <= 3) & (F.coalesce("gs_first", F.lit(0.0)) < 1)
    ref = groups.learn_reference(placed, ["site", "stand"], "lat0", "lon0", still, min_n).drop("n")
    return placed.join(ref, ["site", "stand"]).select(
        "id", S.planar_metres("lat0", "lon0", "ref_lat", "ref_lon").alias("dist_stand_m"))


def trace_features(dep: DataFrame, seg: DataFrame, covered: DataFrame) -> DataFrame:
    """One row per departure. `covered` lists the days with traces, so that a departure without a
    trace on such a day differs from one on a day never processed.

    Departures need id, site, cs, flt, stand, t_off, t_ref (seconds) and day.
    """
    m = pinned(match_traces(dep, seg))  # read by the reference points, the distance and the features
    pos = stand_distance(m, dep)
    days = covered.select("day").distinct().withColumn("_covered", F.lit(True))
    joined = (dep.select("id", "day", "t_off", "t_ref").join(days, "day", "left")
              .join(m.withColumn("_m", F.lit(True)), "id", "left").join(pos, "id", "left"))
    return joined.select(
        "id", S.presence("_covered").alias("day_covered"), S.presence("_m").alias("present"),
        F.col("kind").alias("match_kind"), "dist_stand_m",
        (F.col("t_off") - F.col("t_first_moving")).alias("taxi_moving"),
        (F.col("t_off") - F.col("t_first_ground")).alias("taxi_firstobs"),
        (F.col("t_first_moving") - F.col("t_ref")).alias("moving_vs_ref"),
        (F.col("t_first_ground") - F.col("t_ref")).alias("firstobs_vs_ref"),
        (F.col("t_first_moving") - F.col("t_first_ground")).alias("wait_before_moving"),
        "n_ground", "path_m", "stopped_s", "n_stops", "max_gs", "gs_first",
        S.safe_ratio("path_m", F.col("t_first_air") - F.col("t_first_moving")).alias("mean_speed"))


def surface_features(dep: DataFrame, seg: DataFrame, at: str = "t_ref", window: float = 900) -> DataFrame:
    """(id, moving_now, lifted_prev15): traced aircraft between first movement and last ground point at the departure's site at
    its reference start (`at`), and lift-offs there in the `window` seconds up to it; all segments count, matched to a departure or not.

    A segment that ends when a departure looks has left; one that starts then has not come yet. Departures without site or `at` have no row.
    """
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("long").alias(c)
    asked = dep.select("id", "site", us(at))
    held = seg.select("site", us("t_first_moving"), us("t_last_ground"), us("t_first_air"), F.lit("lifted").alias("kind"))
    now = occupancy.occupancy_at(asked, held, "site", at, "t_first_moving", "t_last_ground", "id", "moving_now")
    lifts = trailing.trailing_counts(held.where("t_first_air IS NOT NULL"), asked, "site", "t_first_air", "kind", ["lifted"], "id", (window,), at)
    return now.join(lifts.toDF("id", "lifted_prev15"), "id")


def coverage_summary(features: DataFrame, scored: DataFrame) -> DataFrame:
    """(part, n, covered, present, pct_of_covered) for the scored and the training rows."""
    parts = setops.membership(features, scored, "id", "scored", "train", "part")
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("day_covered").alias("covered"), F.sum("present").alias("present"),
        (100 * F.try_divide(F.sum("present"), F.sum("day_covered"))).alias("pct_of_covered"))


def witness_report(dep: DataFrame, seg: DataFrame, far: float = 600, tol: float = 60, fallback: float = 120) -> dict[str, DataFrame]:
    """How well candidate start times agree with the true start, per site.

    Departures carry t_start (truth), t_ref, t_sched, y besides the match keys; rows whose
    schedule is unknown or whose target is the schedule gap stay out of the accuracy tables.
    Returns coverage, accuracy, far (rows whose reference is far off), unmatched and headline.
    """
    pairs = match.within_reach(
        match.match_any_key(dep, seg.withColumn("seg_cs", S.normalise("callsign")), [("cs", 1)], "seg_cs", ["site"],
                            "t_off", F.coalesce("t_first_air", "t_last_ground"), 600),
        "t_off", "t_first_air", "t_last_ground")
    cols = ["id", "seg_id", "kind", "dist", "t_first_ground", "t_first_moving"]
    m = match.accept(pairs.select(cols), "id", "seg_id").select("id", "t_first_ground", "t_first_moving", F.lit(True).alias("hit"))
    rows = pinned(dep.join(m, "id", "left"))  # five tables read it
    err = {"ref": F.col("t_ref") - F.col("t_start"), "firstobs": F.col("t_first_ground") - F.col("t_start"),
           "moving": F.col("t_first_moving") - F.col("t_start")}
    share = lambda c: 100 * F.avg(F.when(c, 1.0).when(~c, 0.0))
    rms = lambda e: F.sqrt(F.avg(e * e))
    coverage = rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_dep"), F.count("hit").alias("n_matched"),
        (100 * F.count("hit") / F.count(F.lit(1))).alias("pct_matched"),
        (100 * F.count("t_first_moving") / F.count(F.lit(1))).alias("pct_with_moving"),
        share(F.col("t_first_ground") <= F.col("t_start") + 60).alias("pct_starts_by_block"))
    real = rows.where(F.col("hit") & F.col("t_ref").isNotNull()
                      & (F.abs(F.col("y") - (F.col("t_off") - F.col("t_sched"))) > fallback))
    accuracy = real.groupBy("site").agg(F.count(F.lit(1)).alias("n"), *[
        made for n, e in err.items() for made in (rms(e).alias(f"rmse_{n}"), share(F.abs(e) <= tol).alias(f"pct_{n}"))])
    accuracy = accuracy.join(medians(real, ["site"], {f"med_{n}": e for n, e in err.items()}), "site", "left")
    both = real.where(F.col("t_first_moving").isNotNull())
    off = both.where(F.abs(err["ref"]) > far).groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), share(F.abs(err["moving"]) < F.abs(err["ref"])).alias("pct_trace_closer"))
    off = off.join(medians(both.where(F.abs(err["ref"]) > far), ["site"], {
        "med_abs_ref": F.abs(err["ref"]), "med_abs_moving": F.abs(err["moving"])}), "site", "left")
    unmatched = rows.where(F.col("t_ref").isNull()).groupBy("site").agg(
        F.count(F.lit(1)).alias("n_unmatched"), F.count("hit").alias("n_traced"),
        share(F.abs(err["moving"]) <= 120).alias("pct120_moving"))
    unmatched = unmatched.join(medians(rows.where(F.col("t_ref").isNull()), ["site"], {"med_moving_err": err["moving"]}), "site", "left")
    as_pred = lambda t: rms(F.col("t_off") - t - F.col("y"))
    headline = both.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), as_pred(F.col("t_ref")).alias("rmse_ref"), as_pred(F.col("t_first_moving")).alias("rmse_moving"),
        as_pred(F.col("t_first_ground")).alias("rmse_firstobs"),
        as_pred(F.least("t_ref", "t_first_moving")).alias("rmse_earlier"))
    return {"coverage": coverage, "accuracy": accuracy, "far": off, "unmatched": unmatched, "headline": headline}


def key_precision(dep: DataFrame, seg: DataFrame) -> DataFrame:
    """(kind, n, precision): departures whose callsign is known are matched with it hidden, and the
    found segment's callsign is compared with it."""
    known = dep.where(F.col("cs").isNotNull())
    blind = known.withColumn("cs", F.lit(None).cast("string"))
    found = match_traces(blind, seg, learn_from=dep).select("id", "kind", S.normalise("callsign").alias("found"))
    right = F.when(F.col("found") == F.col("cs"), 1.0).otherwise(0.0)
    return (found.join(known.select("id", "cs"), "id").groupBy("kind")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("precision")))
