"""Departure features: congestion, recent flow, turnaround, revision state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.functions import scalars as S
from rampwise.functions.clock import DAY, SECOND, micros, slot_start, span
from rampwise.operators import asof, setops, trailing
from rampwise.operators.frames import Frame, Measure, Running, instant_frames
from rampwise.operators.scan import tie_rank

# Fixed names of the movement table's columns.
RAW = {
    "id": "MVT_ID_mvt", "phase": "PHASE_mvt", "fin": "MVT_TIME_UTC_mvt", "ref": "AOBT_3_flt", "sched": "SCHED_TIME_UTC_mvt",
    "eobt": "EOBT_1_flt", "lobt": "LOBT_flt", "iobt": "IOBT_flt", "start": "BLOCK_TIME_UTC_mvt", "stand": "STAND_mvt",
    "rwy": "RUNWAY_mvt", "actype": "AIRCRAFT_TYPE_mvt", "wake": "WK_TBL_CAT_flt", "operator": "AIRCRAFT_OPERATOR_flt",
    "segment": "MARKET_SEGMENT_flt", "ades": "ADES_mvt",
}
REVISIONS = ("aobt_vs_eobt", "aobt_vs_lobt", "aobt_vs_iobt")


def canonical(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Short names, the site by phase (origin of a departure, destination of an arrival), the
    flag of a missing second record, and the target as a double."""
    site = F.when(F.col("PHASE_mvt") == "DEP", F.col("ADEP_mvt")).otherwise(F.col("ADES_mvt"))
    return raw.select(*[F.col(c).alias(n) for n, c in RAW.items()], site.alias("site"),
                      F.col("AOBT_3_flt").isNull().alias("unmatched"), F.col("TAXITIME_SEC_mvt").cast("double").alias("y"), *extra)


TURN = ("turnaround_sec", "inbound_delay", "inbound_taxi_in")
STATE = ("arr_taxi_day", "arr_taxi_day_n", "arr_taxi_prev6h")
#: Made from a reference start of the row's own or of the rows around it.
OWN_START = ("arr_taxi_mean60", "dep_recov_mean60", *TURN, *REVISIONS[1:])


def with_turnaround(dep: DataFrame, mv: DataFrame, at: str, max_age: float = 86_400, form: str = "scaled") -> DataFrame:
    """Adds age, delay and taxi-in of the arrival last parked at the departure's stand before `at`."""
    arr = mv.where("phase = 'ARR' AND start IS NOT NULL").select(
        "site", "stand", "start", S.seconds_between(mv, "fin", "sched").alias("inbound_delay"),
        F.col("y").alias("inbound_taxi_in"), F.col("id").alias("arr_id"))
    linked = asof.asof_left(dep, arr, ["site", "stand"], at, "start", list(TURN[1:]), "arr_id", form)
    aged = linked.withColumn("turnaround_sec", (micros(linked, at) - F.col("asof_t")) / SECOND).drop("asof_t")
    return S.null_if_stale(aged, F.col("turnaround_sec"), max_age, TURN, low=0)


def turnaround(mv: DataFrame, max_age: float = 86_400, form: str = "scaled") -> DataFrame:
    """(id, turnaround_sec, inbound_delay, inbound_taxi_in) of departures that have a stand."""
    dep = mv.where("phase = 'DEP' AND stand IS NOT NULL").select("id", "site", "stand", S.first_known("ref", "sched", "fin").alias("at"))
    return with_turnaround(dep, mv, "at", max_age, form).select("id", *TURN)


def with_arrival_state(dep: DataFrame, mv: DataFrame, at: str) -> DataFrame:
    """Adds the day's and the last six hours' arrival taxi means, without the departure's own hour.

    Arrivals whose start equals the schedule are left out.  The hour and day tables hold a row per site
    and hour of the data's time span.
    """
    on_time = F.col("start").isNotNull() & F.col("sched").isNotNull() & (
        F.abs(S.seconds_between(mv, "start", "sched")) <= 120)
    usable = (F.col("phase") == "ARR") & F.col("y").between(60, 7200) & ~on_time
    hours = trailing.bucket_totals(mv, "site", "fin", "y", where=usable).select(
        "site", F.col("bucket").alias("hour"), "total", "n")
    days = (hours.groupBy("site", slot_start("hour", DAY).alias("day"))
            .agg(F.sum("total").alias("day_total"), F.sum("n").alias("day_n")))
    recent = trailing.prev_buckets(hours, "site", 6, bucket="hour")
    placed = setops.join_on_slot(setops.join_on_slot(dep, recent, "site", at, "hour", 3600), days, "site", at, "day", 86_400)
    rest = F.col("day_n") - F.coalesce("n", F.lit(0))
    return placed.select(
        *[dep[c] for c in dep.columns],
        F.when(rest != 0, (F.col("day_total") - F.coalesce("total", F.lit(0.0))) / rest).alias("arr_taxi_day"),
        rest.alias("arr_taxi_day_n"), S.safe_ratio("total_prev", "n_prev").alias("arr_taxi_prev6h"))


def site_moments(mv: DataFrame, windows: Sequence[float] = (900, 1800, 3600), form: str = "scaled") -> DataFrame:
    """State of the surface per (site, instant at which some departure leaves its stand).

    Flow counts, recent means, revision means and the balances of both queues all look at one stream of
    points per site, so they share one reduction to instants and one pass of windows.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    parts = ["takeoff", "landing", "arr_n", "arr_s", "rec_n", "rec_s", "plan_n", "eobt_s", "lobt_s", "abs_lobt_s",
             "dep_in", "dep_out", "arr_in", "arr_out"]
    at = {c: micros(mv, c) for c in ("fin", "ref", "start")}

    def point(t, ask=False, **held):
        return F.struct(at[t].alias("t"), F.lit(ask).alias("ask"), *[
            F.coalesce(held[p].cast("double"), zero).alias(p) if p in held else zero.alias(p) for p in parts])

    gap = lambda a, b: S.seconds_between(mv, a, b)
    when = lambda c, v=one: F.when(c, v)
    queued = F.col("ref") < F.col("fin")
    inbound = F.col("fin") < F.col("start")
    planned = F.col("eobt").isNotNull() & F.col("lobt").isNotNull()
    has_y = F.col("y").isNotNull()
    dep = F.array(
        point("fin", takeoff=one, rec_n=when(F.col("ref").isNotNull()), rec_s=gap("fin", "ref"), dep_out=when(queued)),
        point("ref", ask=True, dep_in=when(queued), plan_n=when(planned), eobt_s=when(planned, gap("ref", "eobt")),
              lobt_s=when(planned, gap("ref", "lobt")), abs_lobt_s=when(planned, F.abs(gap("ref", "lobt")))))
    arr = F.array(
        point("fin", landing=one, arr_n=when(has_y), arr_s=F.col("y"), arr_in=when(inbound)),
        point("start", arr_out=when(inbound)))
    points = mv.select("site", F.explode(F.when(F.col("phase") == "DEP", dep).otherwise(arr)).alias("x")).select("site", "x.*")
    second, hour = SECOND, 3600 * SECOND
    frames = [Frame(f"{k}_prev{w / 60:g}", k, -span(w), 0) for k in ("takeoff", "landing") for w in windows]
    frames += [Frame(f"{m}_60", m, -hour, -second) for m in parts[2:10]]
    frames += [Frame(f"{m}_180", m, -3 * hour, -second) for m in ("plan_n", "eobt_s")]
    measures = [Measure(p, F.col(p)) for p in parts]
    measures += [Measure("dep_net", F.col("dep_in") - F.col("dep_out")), Measure("arr_net", F.col("arr_in") - F.col("arr_out"))]
    found = instant_frames(points, ["site"], "t", measures, frames, [Running("dep_run", "dep_net"), Running("arr_run", "arr_net")],
                           ["dep_in", "arr_in"], F.col("ask"), form)
    mean = lambda s, n, out: S.safe_ratio(F.col(s), F.col(n)).alias(out)
    count = lambda c, out: F.coalesce(c, zero).cast("long").alias(out)
    return found.select(
        "site", "t", *[count(F.col(f.out), f.out) for f in frames if f.measure in ("takeoff", "landing")],
        mean("arr_s_60", "arr_n_60", "arr_taxi_mean60"), mean("rec_s_60", "rec_n_60", "dep_recov_mean60"),
        mean("eobt_s_60", "plan_n_60", "plan_eobt_mean60"), mean("eobt_s_180", "plan_n_180", "plan_eobt_mean180"),
        mean("lobt_s_60", "plan_n_60", "plan_lobt_mean60"), mean("abs_lobt_s_60", "plan_n_60", "plan_abs_lobt_mean60"),
        count(F.col("plan_n_60"), "plan_n60"), count(F.col("dep_run") - F.col("dep_in"), "dep_open"),
        count(F.col("arr_run") - F.col("arr_in"), "arr_open"))


def departure_features(mv: DataFrame, windows: Sequence[float] = (900, 1800, 3600), with_target: bool = True,
                       form: str = "fine") -> DataFrame:
    """One row per departure with about thirty features; `mv` comes from `canonical`.

    A departure's own start and target are never read, so blanking them changes no feature.
    """
    dep = mv.where("phase = 'DEP'")
    gap = lambda a, b: S.seconds_between(mv, a, b)
    base = dep.select(
        "id", "site", "stand", "rwy", "actype", "wake", "operator", "segment", "ades", "unmatched", "fin",
        gap("fin", "sched").alias("D"), gap("fin", "ref").alias("recov"), gap("ref", "eobt").alias("aobt_vs_eobt"),
        gap("ref", "lobt").alias("aobt_vs_lobt"), gap("ref", "iobt").alias("aobt_vs_iobt"), *S.calendar("fin"),
        *(["y"] if with_target else []), micros(mv, "ref").alias("_ref"), micros(mv, "sched").alias("_sched"),
        F.coalesce(F.col("ref") < F.col("fin"), F.lit(False)).alias("_queued"),
        (F.col("ref").isNotNull() & F.col("eobt").isNotNull() & F.col("lobt").isNotNull()).alias("_planned"),
        F.coalesce(micros(mv, "ref"), micros(mv, "sched"), micros(mv, "fin")).alias("_at"))
    moments = site_moments(mv, windows, form).withColumnRenamed("t", "_ref")
    joined = base.join(moments, ["site", "_ref"], "left")
    ranked = tie_rank(joined, ["site", "_ref", "_queued"], "id", "_rank", source=base)
    demand = instant_frames(dep.select("site", micros(mv, "sched").alias("_sched")), ["site"], "_sched",
                            [Measure("n", F.lit(1).cast("long"))], [Frame("sched_dep_60", "n", -span(1800), span(1800))], form=form)
    full = with_turnaround(with_arrival_state(ranked.join(demand, ["site", "_sched"], "left"), mv, "_at"), mv, "_at", form=form)
    plan = [c for c in moments.columns if c.startswith("plan_")]
    same = [c for c in moments.columns if c not in ("site", "_ref", "dep_open", "arr_open", *plan)]
    shown = [c for c in base.columns if not c.startswith("_")]
    return full.select(
        *shown, F.when(F.col("_queued"), F.col("dep_open") + F.col("_rank") - 1).otherwise(0).alias("dep_queue"),
        F.coalesce("arr_open", F.lit(0)).alias("arr_queue"), *same, *[F.when(F.col("_planned"), F.col(c)).alias(c) for c in plan],
        "sched_dep_60", *STATE, *TURN)
