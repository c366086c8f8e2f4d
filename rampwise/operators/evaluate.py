"""Error measures, calibration and output checks; every result is a small DataFrame."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.functions.scalars import bin_by_edges, pearson
from rampwise.operators.quantiles import exact_quantiles, known, ordered_distribution


def squared(y: str, pred: str) -> Column:
    return F.pow(F.col(pred) - F.col(y), F.lit(2))


def rmse(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(squared(y, pred))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def rmse_of_many(df: DataFrame, y: str, preds: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, strategy, rmse): all predictions scored in one pass."""
    wide = df.groupBy(*by).agg(*[F.sqrt(F.avg(squared(y, p))).alias(p) for p in preds])
    return wide.unpivot(list(by), list(preds), "strategy", "rmse")


def worst_group(df: DataFrame, by: str, y: str, preds: Sequence[str]) -> DataFrame:
    """(strategy, by, rmse) of each prediction's worst group."""
    table = rmse_of_many(df, y, preds, [by])
    return table.groupBy("strategy").agg(F.max_by(by, F.struct("rmse", by)).alias(by), F.max("rmse").alias("rmse"))


def hit_rate(df: DataFrame, err: Column, tol: float, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with abs(err) <= tol; rows without an error are left out."""
    return df.groupBy(*by).agg(F.avg(F.when(F.abs(err) <= tol, 1.0).when(F.abs(err) > tol, 0.0)).alias("hit_rate"),
                               F.count(err).alias("n"))


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, low, median, high)."""
    ends = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    mid = exact_quantiles(df, by, value, {"median": 0.5})
    if by:
        return mid.join(ends, list(by)).select(*by, "n", "low", "median", "high")
    return mid.select("n", ends.select("low").scalar().alias("low"), "median", ends.select("high").scalar().alias("high"))


def split_by_month(df: DataFrame, months: Collection[int], year: int | None = None, month: str = "mon",
                   yr: str = "yr") -> tuple[DataFrame, DataFrame]:
    """(fit, validation): the given months (of one year) are held out."""
    held = F.col(month).isin(list(months))
    if year is not None:
        held = held & (F.col(yr) == year)
    held = F.coalesce(held, F.lit(False))
    return df.where(~held), df.where(held)


def composition(scored: DataFrame, site: str, month: str, min_share: float = 0.01) -> DataFrame:
    """(site, month, n, site_n, weight, real): rows per site and month of the scored file.

    `real` marks months with at least `min_share` of their site's rows; `weight` is the site's share
    of all scored rows.  The table has at most twelve rows per site.
    """
    cells = scored.groupBy(site, month).agg(F.count(F.lit(1)).alias("n"))
    sites = cells.groupBy(site).agg(F.sum("n").alias("site_n"))
    total = scored.agg(F.count(F.lit(1))).scalar()
    return (cells.join(sites, site)
            .withColumns({"weight": F.col("site_n") / total, "real": F.col("n") >= min_share * F.col("site_n")}))


def composition_rmse(val: DataFrame, scored: DataFrame, site: str, month: str, y: str, pred: str, min_share: float = 0.01,
                     unstable: Collection[str] = (), covered: str | None = None) -> DataFrame:
    """(part, label, rmse, share): validation error as the scored file would weigh it.

    Each site counts on its real months only, with its share of all scored rows.  Parts: `site`, `all`,
    `stable` (without the unstable sites), `month` (stable sites, weighed by that month's rows) and
    `covered` (stable sites, by flag).
    """
    mix = composition(scored, site, month, min_share).where("real")
    flags = [covered] if covered else []
    cells = val.groupBy(site, month, *flags).agg(F.sum(squared(y, pred)).alias("se"), F.count(F.lit(1)).alias("rows"))
    joined = cells.join(mix, [site, month])
    mse = F.sum("se") / F.sum("rows")
    # The same small table of cells feeds every part.
    by_site = joined.groupBy(site).agg(mse.alias("mse"), F.first("weight").alias("weight"), F.first("site_n").alias("site_n"))
    stable = ~F.col(site).isin(list(unstable)) if unstable else F.lit(True)
    root = lambda w: F.sqrt(F.sum(w * F.col("mse")) / F.sum(w)).alias("rmse")
    parts = [
        by_site.select(F.lit("site").alias("part"), F.col(site).cast("string").alias("label"), F.sqrt("mse").alias("rmse"),
                       F.col("weight").alias("share")),
        by_site.agg(F.sqrt(F.sum(F.col("weight") * F.col("mse"))).alias("rmse"), F.sum("weight").alias("share"))
        .select(F.lit("all").alias("part"), F.lit("all").alias("label"), "rmse", "share"),
        by_site.where(stable).agg(root(F.col("weight")), F.sum("weight").alias("share"))
        .select(F.lit("stable").alias("part"), F.lit("stable").alias("label"), "rmse", "share")]
    months = (joined.where(stable).groupBy(site, month).agg(mse.alias("mse"), F.first("n").alias("n"))
              .groupBy(month).agg(root(F.col("n"))))
    parts.append(months.select(F.lit("month").alias("part"), F.col(month).cast("string").alias("label"), "rmse",
                               F.lit(None).cast("double").alias("share")))
    if covered:
        lanes = (joined.where(stable).groupBy(site, covered).agg(mse.alias("mse"), F.first("site_n").alias("site_n"))
                 .groupBy(covered).agg(root(F.col("site_n"))))
        parts.append(lanes.select(F.lit("covered").alias("part"), F.col(covered).cast("string").alias("label"), "rmse",
                                  F.lit(None).cast("double").alias("share")))
    return reduce(DataFrame.unionByName, parts)


def calibration(df: DataFrame, p: str, label: Column, edges: Sequence[float]) -> DataFrame:
    """(bin, n, predicted, observed): bin i holds edges[i] <= p < edges[i+1]."""
    inside = df.where((F.col(p) >= edges[0]) & (F.col(p) < edges[-1]))
    return (inside.groupBy((bin_by_edges(p, edges) - 1).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"),
                 F.avg(F.when(label, 1.0).otherwise(0.0)).alias("observed")))


def check_output(out: DataFrame, template: DataFrame, id: str, value: str) -> DataFrame:
    """(violation, n), a row per broken rule; no rows means the output is fit to send.

    Columns must be exactly id and value; ids neither repeated, missing nor extra; values neither
    null, NaN nor negative.
    """
    spark = out.sparkSession
    odd = set(out.columns) ^ {id, value}
    checks = [spark.range(1).select(F.lit("columns").alias("violation"), F.lit(len(odd)).cast("long").alias("n"))]
    if {id, value} <= set(out.columns):
        v = F.col(value).cast("double")
        # Per id first: an id repeated often is reduced before it moves.
        ids = out.groupBy(id).agg(F.count(F.lit(1)).alias("c"), F.count_if(v.isNull() | F.isnan(v) | (v < 0)).alias("bad"))
        both = ids.withColumn("_out", F.lit(True)).join(
            template.groupBy(id).agg(F.count(F.lit(1)).alias("t")), ids[id].eqNullSafe(template[id]), "full")
        table = both.agg(
            F.sum(F.when(F.col("_out"), F.col("c") - F.when(ids[id].isNotNull(), 1).otherwise(0))).alias("duplicate"),
            F.sum(F.when(F.col("_out").isNull(), F.col("t"))).alias("missing"),
            F.sum(F.when(F.col("t").isNull(), F.col("c"))).alias("extra"), F.sum("bad").alias("invalid"))
        checks.append(table.unpivot([], ["duplicate", "missing", "extra", "invalid"], "violation", "n"))
    return reduce(DataFrame.unionByName, checks).where(F.coalesce("n", F.lit(0)) > 0)


def leaderboard(df: DataFrame, team: str, score: str) -> DataFrame:
    """(rank, team, best, submissions): smallest score per team; teams without a score, or with NaN alone, are unranked."""
    best = df.groupBy(team).agg(F.min(score).alias("best"), F.count(F.lit(1)).alias("submissions")).where(known("best", dict(df.dtypes)[score]))
    places = ordered_distribution(best, "best").select("best", (F.col("run_n") - F.col("n") + 1).alias("rank"))
    return best.join(places, "best").select("rank", team, "best", "submissions")


def pareto(df: DataFrame, se: Column, tops: Sequence[float | int]) -> DataFrame:
    """(top, share): part of the squared error in the worst rows; an int is a number of rows, a float a fraction.

    Rows whose error is null or NaN are left out.
    """
    ranked = ordered_distribution(df.withColumn("_se", se), "_se", descending=True)
    n = ranked.agg(F.sum("n")).scalar()
    limits = [F.lit(t).cast("double") if isinstance(t, int) else F.ceil(F.lit(t) * n).cast("double") for t in tops]
    before = F.col("run_n") - F.col("n")
    taken = [F.try_divide(F.sum(F.least(F.col("n").cast("double"), F.greatest(F.lit(0.0), lim - before)) * F.col("_se")),
                          F.sum(F.col("n") * F.col("_se"))) for lim in limits]
    names = [str(t) for t in tops]
    return ranked.agg(*[e.alias(f"_{i}") for i, e in enumerate(taken)]).select(F.explode(F.array(*[
        F.struct(F.lit(names[i]).alias("top"), F.col(f"_{i}").alias("share")) for i in range(len(tops))])).alias("x")).select("x.*")


def error_share(df: DataFrame, se: Column, by: Sequence[str]) -> DataFrame:
    """(by, n, share of the squared error)."""
    made = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(se).alias("_s"))
    return made.select(*by, "n", F.try_divide("_s", made.agg(F.sum("_s")).scalar()).alias("share"))


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    """(bucket, n): bucket is the lower end."""
    return (df.where(value.isNotNull()).groupBy((F.floor(value / width) * width).cast("double").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def gram(df: DataFrame, members: Sequence[str], y: str) -> DataFrame:
    """(left, right, value): the products P'P and P'y, from which blend weights are solved on the driver."""
    pairs = [(a, b) for i, a in enumerate(members) for b in [*members[i:], y]]
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return (sums.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "value")
            .select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("left"),
                    F.split_part("pair", F.lit("|"), F.lit(2)).alias("right"), "value"))


def residual_correlation(df: DataFrame, members: Sequence[str], y: str) -> DataFrame:
    """(left, right, r) of the members' residuals."""
    pairs = [(a, b) for i, a in enumerate(members) for b in members[i + 1:]]
    res = lambda c: F.col(c) - F.col(y)
    wide = df.agg(*[pearson(res(a), res(b)).alias(f"{a}|{b}") for a, b in pairs])
    return (wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
            .select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("left"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("right"), "r"))
