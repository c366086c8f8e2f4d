"""Hierarchies of group estimators and the group-based predictors built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.functions.scalars import bin_by_edges, clip
from rampwise.operators.quantiles import exact_quantiles, known, medians, quantile_levels
from rampwise.operators.setops import fallback_lookup

SITE_LEVELS = (("site", "stand", "rwy"), ("site", "rwy"), ("site",))
Levels = list[tuple[Sequence[str], DataFrame, str]]


def group_mean(df: DataFrame, keys: Sequence[str], y: str, min_n: int = 1) -> DataFrame:
    return (df.groupBy(*keys).agg(F.avg(y).alias("p"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_n))


def group_median(df: DataFrame, keys: Sequence[str], y: str, min_n: int = 1) -> DataFrame:
    return exact_quantiles(df, keys, y, {"p": 0.5}).where(F.col("n") >= min_n).select(*keys, "p", "n")


def _partials(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    sums = [F.sum(c).alias(f"s_{k}") for k, c in values.items()]
    counts = [F.count(c).alias(f"c_{k}") for k, c in values.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *counts)


def _rolled(fine: DataFrame, levels: Sequence[Sequence[str]], names: Sequence[str], min_n: Sequence[int]) -> list[DataFrame]:
    """Coarser levels are summed from the finest one, so the rows are grouped once."""
    out = []
    for i, (keys, least) in enumerate(zip(levels, min_n)):
        held = fine if i == 0 else fine.groupBy(*keys).agg(
            F.sum("n").alias("n"), *[F.sum(f"{p}_{k}").alias(f"{p}_{k}") for p in "sc" for k in names])
        out.append(held.where(F.col("n") >= least).select(
            *keys, *[F.try_divide(F.col(f"s_{k}"), F.col(f"c_{k}")).alias(k) for k in names]))
    return out


def mean_levels(df: DataFrame, levels: Sequence[Sequence[str]], y: str, min_n: Sequence[int]) -> Levels:
    """One table of means per level, fine to coarse, each with its least group size."""
    fine = _partials(df, levels[0], {"p": F.col(y)})
    return [(k, t, "p") for k, t in zip(levels, _rolled(fine, levels, ["p"], min_n))]


def median_levels(df: DataFrame, levels: Sequence[Sequence[str]], y: str, min_n: Sequence[int]) -> Levels:
    return [(k, t.where(F.col("n") >= n).select(*k, "p"), "p") for k, t, n in zip(levels, quantile_levels(df, levels, y, {"p": 0.5}), min_n)]


def overall(df: DataFrame, y: str) -> Column:
    """The global mean as a scalar subquery."""
    return df.agg(F.avg(y)).scalar()


def winsorised_predictions(fit: DataFrame, target: DataFrame, levels: Sequence[Sequence[str]], y: str,
                           caps: dict[str, float | None], min_n: Sequence[int]) -> DataFrame:
    """A column per cap: hierarchical means of least(y, cap), all caps from one pass over the rows."""
    values = {n: F.col(y) if cap is None else F.least(F.col(y), F.lit(cap)) for n, cap in caps.items()}
    tables = _rolled(_partials(fit, levels[0], values), levels, list(values), min_n)
    found = target
    for i, (keys, table) in enumerate(zip(levels, tables)):
        found = found.join(table.select(*keys, *[F.col(n).alias(f"_{i}_{n}") for n in values]), list(keys), "left")
    whole = fit.agg(*[F.avg(c).alias(n) for n, c in values.items()])
    return found.select(*[target[c] for c in target.columns], *[
        F.coalesce(*[F.col(f"_{i}_{n}") for i in range(len(levels))], whole.select(n).scalar()).alias(n) for n in values])


def cell_rate(df: DataFrame, keys: Sequence[str], y: str, d: str, tol: float = 60, min_n: int = 20,
              out: str = "p") -> DataFrame:
    """Share of rows with abs(y-d) <= tol per cell, over rows that have d."""
    hit = F.when(F.abs(F.col(y) - F.col(d)) <= tol, 1.0).otherwise(0.0)
    return (df.where(F.col(d).isNotNull()).groupBy(*keys)
            .agg(F.avg(hit).alias(out), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n))


def share_of_total(df: DataFrame, keys: Sequence[str], out: str = "share") -> DataFrame:
    """(keys, n, share): the total is a second aggregate, over the groups."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(out, F.col("n") / counts.agg(F.sum("n")).scalar())


def learn_code_map(df: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target): the commonest target of each source code, the smaller code on a tie.

    The winner is found first: a source whose commonest target is empty is dropped, as is an
    empty source.
    """
    counts = (df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
              .groupBy(source, target).agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(source).agg(F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias(target))
    return best.where((F.col(source) != "") & (F.col(target) != ""))


def learn_reference(df: DataFrame, keys: Sequence[str], lat: str, lon: str, where: Column, min_n: int = 5) -> DataFrame:
    """Median position per key from the rows that qualify."""
    rows = df.where(where)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    both = medians(rows, keys, {"ref_lat": F.col(lat), "ref_lon": F.col(lon)})
    n = rows.groupBy(*keys).agg(F.count(F.when(known(lat), F.col(lat))).alias("n"))
    return n.where(F.col("n") >= min_n).join(both, list(keys)).where("ref_lat IS NOT NULL AND ref_lon IS NOT NULL").select(*keys, "n", "ref_lat", "ref_lon")


def median_baseline(fit: DataFrame, target: DataFrame, levels: Sequence[Sequence[str]], y: str,
                    min_n: Sequence[int], out: str = "pred") -> DataFrame:
    """Group medians from fine to coarse, then the global median."""
    whole = median_levels(fit, [*levels, ()], y, [*min_n, 1])
    return fallback_lookup(target, whole[:-1], whole[-1][1].select("p").scalar(), out)


def mean_baseline(fit: DataFrame, target: DataFrame, levels: Sequence[Sequence[str]], y: str,
                  min_n: Sequence[int], out: str = "pred") -> DataFrame:
    return fallback_lookup(target, mean_levels(fit, levels, y, min_n), overall(fit, y), out)


def direct_and_offset(fit: DataFrame, target: DataFrame, levels: Sequence[Sequence[str]], y: str, recov: str,
                      min_n: Sequence[int], low: float, high: float) -> DataFrame:
    """`direct`: group mean of y. `offset`: recov + group mean of (y - recov), or direct without recov."""
    gap = fit.withColumn("_gap", F.col(y) - F.col(recov)).where(F.col("_gap").isNotNull())
    both = mean_baseline(fit, target, levels, y, min_n, "direct")
    both = mean_baseline(gap, both, levels, "_gap", min_n, "_shift")
    offset = F.when(F.col(recov).isNotNull(), F.col(recov) + F.col("_shift")).otherwise(F.col("direct"))
    return both.select(*target.columns, clip("direct", low, high).alias("direct"), clip(offset, low, high).alias("offset"))


def choose_strategy(scored: DataFrame, site: str, y: str) -> DataFrame:
    """(site, rmse_direct, rmse_offset, n, use_offset): offset only where strictly better."""
    err = lambda p: F.sqrt(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))).alias(f"rmse_{p}")
    table = scored.groupBy(site).agg(err("direct"), err("offset"), F.count(F.lit(1)).alias("n"))
    return table.withColumn("use_offset", F.col("rmse_offset") < F.col("rmse_direct"))


def apply_strategy(scored: DataFrame, choice: DataFrame, site: str, out: str = "pred") -> DataFrame:
    """A site without a choice predicts directly."""
    picked = scored.join(choice.select(site, "use_offset"), site, "left")
    return picked.select(*[scored[c] for c in scored.columns],
                         F.when(F.col("use_offset"), F.col("offset")).otherwise(F.col("direct")).alias(out))


def is_fallback(y: str, d: str, tol: float = 60) -> Column:
    """Whether the target is the schedule gap: false where d is unknown."""
    return F.coalesce(F.abs(F.col(y) - F.col(d)) <= tol, F.lit(False))


def mixture(p: Column, d: Column, normal: Column, low: float = 60, high: float = 90_000) -> Column:
    """p*d + (1-p)*normal, clipped; without d the normal term alone."""
    share = F.coalesce(p, F.lit(0.0))
    return clip(F.when(d.isNull(), normal).otherwise(share * d + (1 - share) * normal), low, high)


def binned_mixture(fit: DataFrame, target: DataFrame, levels: Sequence[Sequence[str]], site: str, y: str, d: str,
                   edges: Sequence[float], min_n: Sequence[int], matched: str | None = None, tol: float = 60,
                   cell_n: int | None = None, low: float = 60, high: float = 40_000, out: str = "pred") -> DataFrame:
    """Mixture with p by cell of (site[, matched], bin of d).

    Without `matched` a thin cell takes its bin's pooled rate; with it, the rate of (site, matched),
    never that of other sites.  The normal term is fitted on rows whose target is not d.
    """
    cell = [site, "_bin"] if matched is None else [site, matched, "_bin"]
    thin = ["_bin"] if matched is None else [site, matched]
    least = cell_n if cell_n is not None else (30 if matched is None else 20)
    binned = lambda df: df.withColumn("_bin", bin_by_edges(d, edges))
    rates = cell_rate(binned(fit), cell, y, d, tol, least)
    coarse = cell_rate(binned(fit), thin, y, d, tol, 1)
    normal = mean_baseline(fit.where(~is_fallback(y, d, tol)), target, levels, y, min_n, "_normal")
    with_p = fallback_lookup(binned(normal), [(cell, rates, "p"), (thin, coarse, "p")], 0.0, "_p")
    return with_p.select(*target.columns, mixture(F.col("_p"), F.col(d), F.col("_normal"), low, high).alias(out))


def override(df: DataFrame, pred: str, rule: Column, value: Column, low: float = 60, high: float = 90_000) -> DataFrame:
    """Replace the prediction where the rule holds; the clip applies to the replacement too."""
    return df.withColumn(pred, F.when(rule, clip(value, low, high)).otherwise(F.col(pred)))


def banded_shares(df: DataFrame, d: str, edges: Sequence[float], classes: dict[str, Column], smooth: float = 5) -> DataFrame:
    """(band, n, one share per class): (hits + smooth*pooled) / (n + smooth).

    `edges` are the inner band limits; every band is listed, also an empty one.
    """
    band = bin_by_edges(d, edges)
    hits = df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.when(c, 1.0).otherwise(0.0)).alias(k) for k, c in classes.items()])
    every = df.sparkSession.range(len(edges) + 1).withColumnRenamed("id", "band")
    pooled = {k: df.agg(F.avg(F.when(c, 1.0).otherwise(0.0))).scalar() for k, c in classes.items()}
    n = F.coalesce("n", F.lit(0))
    return every.join(hits, "band", "left").select("band", n.alias("n"), *[
        ((F.coalesce(F.col(k), F.lit(0.0)) + smooth * pooled[k]) / (n + smooth)).alias(k) for k in classes])


def three_way(q: Column, r: Column, d: Column, normal: Column, day: float = 86_400,
              low: float = 60, high: float = 90_000) -> Column:
    """q*d + r*(day + normal) + (1-q-r)*normal, clipped."""
    return clip(q * d + r * (day + normal) + (1 - q - r) * normal, low, high)
