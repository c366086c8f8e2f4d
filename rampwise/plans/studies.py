"""The reporting-gap study and the audit of a scored file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.functions import scalars as S
from rampwise.operators import trailing
from rampwise.operators.quantiles import exact_quantiles
from rampwise.sources.files import audit_columns

BANDS = [(0, "a exact"), (60, "b within 1 min"), (600, "c 1-10 min")]


def departure_gaps(mv: DataFrame, limit: float = 3600, tol: float = 60) -> DataFrame:
    """Departures with all estimates, a plausible gap and a target that is not the schedule gap."""
    gap = S.seconds_between(mv, "ref", "start")
    off_schedule = F.col("sched").isNull() | (F.abs(F.col("y") - S.seconds_between(mv, "fin", "sched")) > tol)
    rows = mv.where((F.col("phase") == "DEP") & F.col("y").isNotNull() & (F.abs(gap) < limit) & off_schedule)
    return rows.select("id", "site", F.col("ref").alias("t"), gap.alias("gap"),
                       *[S.seconds_between(mv, "ref", c).alias(f"d_{c}") for c in ("lobt", "iobt", "eobt")]
                       ).dropna(subset=["d_lobt", "d_iobt", "d_eobt"])


def arrival_gaps(raw: DataFrame, limit: float = 3600) -> DataFrame:
    gap = S.seconds_between(raw, "MVT_TIME_UTC_mvt", "ARVT_3_flt")
    return raw.where((F.col("PHASE_mvt") == "ARR") & (F.abs(gap) < limit)).select(
        F.col("MVT_ID_mvt").alias("id"), F.col("ADES_mvt").alias("site"), F.col("MVT_TIME_UTC_mvt").alias("t"), gap.alias("gap"))


def gap_clustering(dep: DataFrame, arr: DataFrame, form: str = "scaled") -> DataFrame:
    """Per site: does the previous hours' mean gap of departures or arrivals carry a departure's gap?"""
    both = (dep.select("site", "t", F.lit("D").alias("kind"), "gap")
            .unionByName(arr.select("site", "t", F.lit("A").alias("kind"), "gap")))
    hour = trailing.trailing_means(both, dep, "site", "t", "kind", "gap", ["D", "A"], "id", 3600, form=form)
    three = trailing.trailing_means(both, dep, "site", "t", "kind", "gap", ["A"], "id", 10_800, form=form)
    rows = dep.join(hour, "id", "left").join(three, "id", "left")
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("gap").alias("sd_gap"), S.pearson("gap", "D_mean60").alias("r_previous_gaps"),
        S.pearson("gap", "A_mean60").alias("r_arrival_60"), S.pearson("gap", "A_mean180").alias("r_arrival_180"))


def gap_by_revision(dep: DataFrame, column: str = "d_lobt", bands: Sequence[tuple[float, str]] = BANDS) -> DataFrame:
    total = dep.agg(F.count(F.lit(1))).scalar()
    return dep.groupBy(S.labelled_band(column, bands, "d more").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd_gap")
    ).withColumn("pct", 100 * F.col("n") / total)


def gap_correlations(dep: DataFrame) -> DataFrame:
    return dep.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("gap").alias("sd_gap"),
                   *[S.pearson("gap", f"d_{c}").alias(f"r_{c}") for c in ("lobt", "iobt", "eobt")])


def gap_nowcast(dep: DataFrame, form: str = "scaled") -> DataFrame:
    """Correlation with means over the other departures of the previous hour."""
    now = trailing.nowcast(dep, "site", "t", ["gap", "d_eobt", "d_lobt"], "id", (3600,), form=form)
    return dep.select("id", "site", "gap").join(now, "id").groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), S.pearson("gap", "gap_mean60").alias("r_previous_gaps"),
        S.pearson("gap", "d_eobt_mean60").alias("r_eobt"), S.pearson("gap", "d_lobt_mean60").alias("r_lobt"))


def scored_file_audit(raw: DataFrame, tokens: Sequence[str] = ("AOBT", "OBT", "BLOCK"), phase: str = "DEP") -> dict[str, DataFrame]:
    """Fill rates of the candidate columns, the duration each implies, and its error against the target."""
    rows = raw.where(F.col("PHASE_mvt") == phase)
    chosen = [c for c in raw.columns if any(t in c.upper() for t in tokens)
              and raw.schema[c].dataType.typeName().startswith("timestamp")]
    long = rows.select(F.col("TAXITIME_SEC_mvt").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), S.seconds_between(raw, "MVT_TIME_UTC_mvt", c).alias("implied"))
        for c in chosen])).alias("x")).select("y", "x.*").where(F.col("implied").isNotNull())
    ends = long.groupBy("column").agg(F.min("implied").alias("min_s"), F.max("implied").alias("max_s"))
    implied = exact_quantiles(long, ["column"], "implied", {"median_s": 0.5}).join(ends, "column")
    error = exact_quantiles(long.withColumn("abs_err", F.abs(F.col("implied") - F.col("y"))), ["column"], "abs_err",
                            {"median_err": 0.5, "p90_err": 0.9})
    return {"fill": audit_columns(raw, tokens, F.col("PHASE_mvt") == phase), "implied": implied, "error": error}
