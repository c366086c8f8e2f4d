"""Diagnostics of errors, features and shifts between periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.functions.clock import DAY, micros, slot_start
from rampwise.functions.scalars import bin_by_edges, pearson
from rampwise.operators.evaluate import squared
from rampwise.operators.quantiles import exact_quantiles, ordered_distribution
from rampwise.operators.scan import neighbours


def tail_calibration(df: DataFrame, pred: str, y: str, tops: Sequence[float]) -> DataFrame:
    """(top, n, predicted, actual) over the rows with the highest predictions: percent rank <= top."""
    ranked = ordered_distribution(df, pred, {"sy": F.col(y)}, descending=True)
    n = ranked.agg(F.sum("n")).scalar()
    place = F.coalesce(F.try_divide(F.col("run_n") - F.col("n"), n - 1), F.lit(0.0))
    tiers = F.explode(F.array(*[F.lit(float(t)) for t in tops])).alias("top")
    return (ranked.select("*", place.alias("place")).select("*", tiers).where(F.col("place") <= F.col("top"))
            .groupBy("top").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col(pred)) / F.sum("n")).alias("predicted"),
                                (F.sum("sy") / F.sum("n")).alias("actual")))


def bands(df: DataFrame, by: str, edges: Sequence[float], values: Mapping[str, Column]) -> DataFrame:
    """(band, n, mean of each value) by band of a column: error by true value, response to a queue, and so on."""
    return (df.groupBy(bin_by_edges(by, edges).alias("band"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for k, c in values.items()]))


def error_bands(df: DataFrame, y: str, pred: str, edges: Sequence[float]) -> DataFrame:
    """(band, n, rmse, bias, share of squared error) by true value."""
    made = df.groupBy(bin_by_edges(y, edges).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(squared(y, pred))).alias("rmse"),
        F.avg(F.col(pred) - F.col(y)).alias("bias"), F.sum(squared(y, pred)).alias("_s"))
    return made.select("band", "n", "rmse", "bias", F.try_divide("_s", made.agg(F.sum("_s")).scalar()).alias("share"))


def oracle_gain(df: DataFrame, y: str, pred: str, classes: Mapping[str, Column]) -> DataFrame:
    """(class, n, rmse, gain): the error if the rows of one class were known exactly."""
    se = squared(y, pred)
    base = F.sqrt(F.avg(se))
    wide = df.agg(base.alias("base"), *[
        made for k, c in classes.items() for made in (
            F.sqrt(F.avg(F.when(c, 0.0).otherwise(se))).alias(f"r_{k}"), F.count_if(c).alias(f"n_{k}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"n_{k}").alias("n"), F.col(f"r_{k}").alias("rmse"),
                                        (F.col("base") - F.col(f"r_{k}")).alias("gain")) for k in classes])).alias("x")
    return wide.select(rows).select("x.*")


def oof_group_effect(df: DataFrame, groupings: Mapping[str, Sequence[str]], residual: str, half: str) -> DataFrame:
    """(grouping, explained): share of residual variance that the other half's group means predict.

    `half` is a 0/1 column; a group the other half lacks predicts 0.
    """
    parts = []
    total = df.agg(F.sum(F.pow(residual, F.lit(2)))).scalar()
    for name, keys in groupings.items():
        means = df.groupBy(*keys, (1 - F.col(half)).alias(half)).agg(F.avg(residual).alias("_m"))
        # Only sums are needed, so rows are reduced to (keys, half) before the join.
        cells = df.groupBy(*keys, half).agg(F.sum(residual).alias("s"), F.sum(F.pow(residual, F.lit(2))).alias("ss"),
                                            F.count(residual).alias("n"))
        m = F.coalesce("_m", F.lit(0.0))
        left = F.sum(F.col("ss") - 2 * m * F.col("s") + F.col("n") * m * m)
        parts.append(cells.join(means, [*keys, half], "left").agg((1 - F.try_divide(left, total)).alias("explained"))
                     .select(F.lit(name).alias("grouping"), "explained"))
    return reduce(DataFrame.unionByName, parts)


def target_encode_oof(df: DataFrame, keys: Sequence[str], y: str, fold: str, smooth: float = 20, out: str = "encoded") -> DataFrame:
    """(rows, out): smoothed mean of y over the key's rows of the *other* folds.

    (sum + smooth*prior) / (n + smooth), the prior being the other folds' overall mean.
    """
    cells = df.groupBy(*keys, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    whole = cells.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    folds = df.groupBy(fold).agg(F.sum(y).alias("fs"), F.count(y).alias("fn"))
    all_s, all_n = df.agg(F.sum(y)).scalar(), df.agg(F.count(y)).scalar()
    prior = folds.select(fold, F.try_divide(all_s - F.col("fs"), all_n - F.col("fn")).alias("prior"))
    rest_n = F.col("tn") - F.col("n")
    value = (F.col("ts") - F.col("s") + smooth * F.col("prior")) / (rest_n + smooth)
    table = cells.join(whole, list(keys)).join(prior, fold).select(*keys, fold, value.alias(out))
    return df.join(table, [*keys, fold], "left").select(*[df[c] for c in df.columns], out)


def prevalence(sets: Mapping[str, DataFrame], condition: Column) -> DataFrame:
    """(dataset, n, rate) of a condition."""
    parts = [d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("rate"))
             .select(F.lit(name).alias("dataset"), "n", "rate") for name, d in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def coverage(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, n, fill rate of each column)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[(F.count(c) / F.count(F.lit(1))).alias(c) for c in columns])


def shift_transfer(df: DataFrame, site: str, month: str, period: str, y: str, first, second) -> tuple[DataFrame, DataFrame]:
    """Mean of y per (site, month) in two periods with the shift, and the correlation of the periods' deviations from
    their site's mean."""
    cells = df.where(F.col(period).isin(first, second)).groupBy(site, month).agg(
        *[F.avg(F.when(F.col(period) == p, F.col(y))).alias(n) for n, p in (("a", first), ("b", second))])
    both = cells.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("shift", F.col("b") - F.col("a"))
    centre = both.groupBy(site).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    r = both.join(centre, site).agg(F.count(F.lit(1)).alias("cells"), pearson(F.col("a") - F.col("ma"), F.col("b") - F.col("mb")).alias("r"),
                                    F.avg(F.abs("shift")).alias("mean_abs_shift"))
    return both, r


def auc(df: DataFrame, score: str, label: Column, top: float = 0.01) -> DataFrame:
    """(positives, negatives, auc, capture): exact AUC with half credit for ties, and the share of positives among rows
    whose descending rank is within `top` of all rows."""
    ranked = ordered_distribution(df, score, {"pos": F.when(label, 1).otherwise(0).cast("long")}, descending=True)
    above = (F.col("run_n") - F.col("n")) - (F.col("run_pos") - F.col("pos"))
    neg = F.col("n") - F.col("pos")
    # A pair is lost for every negative above; half for every tied one.
    lost = F.sum(F.col("pos") * (above + neg / 2))
    n = ranked.agg(F.sum("n")).scalar()
    caught = F.sum(F.when(F.col("run_n") - F.col("n") + 1 <= top * n, F.col("pos")).otherwise(0))
    return ranked.agg(F.sum("pos").alias("positives"), F.sum(neg).alias("negatives"),
                      (1 - F.try_divide(lost, F.sum("pos") * F.sum(neg))).alias("auc"), F.try_divide(caught, F.sum("pos")).alias("capture"))


def rate_drift(df: DataFrame, keys: Sequence[str], period: str, hit: Column, first, second, min_n: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rate of a condition per key in two periods, and the correlation and largest shift over keys seen in both."""
    n = lambda p: F.count_if(F.col(period) == p)
    rate = lambda p: F.avg(F.when(F.col(period) == p, F.when(hit, 1.0).otherwise(0.0)))
    cells = df.groupBy(*keys).agg(n(first).alias("n_a"), n(second).alias("n_b"), rate(first).alias("a"), rate(second).alias("b"))
    both = cells.where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    return both, both.agg(F.count(F.lit(1)).alias("cells"), pearson("a", "b").alias("r"),
                          F.max(F.abs(F.col("b") - F.col("a"))).alias("max_shift"))


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """(r_xy, r_partial) given a control, over rows that have all three."""
    rows = df.dropna(subset=[x, y, z])
    r = rows.agg(pearson(x, y).alias("xy"), pearson(x, z).alias("xz"), pearson(y, z).alias("yz"))
    return r.select(F.col("xy").alias("r_xy"),
                    F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.pow("xz", F.lit(2))) * (1 - F.pow("yz", F.lit(2))))).alias("r_partial"))


def bias_removed(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    """(rmse, rmse_unbiased) with the mean residual of each group taken out, from group sums alone."""
    res = F.col(pred) - F.col(y)
    cells = df.groupBy(*by).agg(F.sum(res).alias("s"), F.sum(res * res).alias("ss"), F.count(res).alias("n"))
    return cells.agg(F.sqrt(F.try_divide(F.sum("ss"), F.sum("n"))).alias("rmse"),
                     F.sqrt(F.try_divide(F.sum(F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n"))), F.sum("n"))).alias("rmse_unbiased"))


def residual_by_class(df: DataFrame, y: str, pred: str, flags: Sequence[str]) -> DataFrame:
    res = F.col(pred) - F.col(y)
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"), F.avg(res).alias("bias"), F.sqrt(F.avg(res * res)).alias("rmse"))


def feature_drift(a: DataFrame, b: DataFrame, features: Sequence[str], silent: float = 0.99) -> DataFrame:
    """(feature, null_a, null_b, mean_a, mean_b, shift_sd, silent): one wide aggregate per period.

    `shift_sd` is the change of mean in standard deviations of `a`; `silent` marks a feature that is
    almost always null in `b` only.
    """
    def profile(df, side):
        wide = df.agg(*[F.struct((1 - F.try_divide(F.count(c), F.count(F.lit(1)))).alias("null"), F.avg(F.col(c).cast("double")).alias("mean"),
                                 F.stddev_samp(F.col(c).cast("double")).alias("sd")).alias(c) for c in features])
        return wide.unpivot([], list(features), "feature", side)
    both = profile(a, "a").join(profile(b, "b"), "feature")
    return both.select(
        "feature", F.col("a.null").alias("null_a"), F.col("b.null").alias("null_b"), F.col("a.mean").alias("mean_a"),
        F.col("b.mean").alias("mean_b"), F.try_divide(F.col("b.mean") - F.col("a.mean"), F.col("a.sd")).alias("shift_sd"),
        ((F.col("b.null") >= silent) & (F.col("a.null") < silent)).alias("silent"))


def sequence_gap(df: DataFrame, key: str, t: str, cls: str, id: str) -> DataFrame:
    """(class of the predecessor, n, median seconds since it) at the same key."""
    rows = df.select(F.col(key).alias("key"), micros(df, t).alias("t"), F.col(cls).alias("cls"), F.col(id).alias("id"))
    stepped = neighbours(rows.withColumn("_day", slot_start("t", DAY)), ["key"], "_day", ["t", "id"], ["t", "cls"], following=None)
    gaps = stepped.where(F.col("prev.t").isNotNull()).select(F.col("prev.cls").alias(cls), ((F.col("t") - F.col("prev.t")) / 1e6).alias("gap"))
    return exact_quantiles(gaps, [cls], "gap", {"median_gap": 0.5})


def lag_correlation(df: DataFrame, residual: str, previous: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of a residual with the mean residual of the hour before."""
    return df.groupBy(*by).agg(F.count(previous).alias("n"), pearson(residual, previous).alias("r"))


def configuration_state(df: DataFrame, key: str, t: str, resource: str, id: str, width: int = 1_800_000_000) -> DataFrame:
    """(id, in_use, modal, changed, own_share) of the half hour before the row's own.

    A bucket is described by its counts per resource; `changed` compares its mode with that of the
    bucket before it, `own_share` is the share of the row's own resource in it.
    """
    rows = df.select(F.col(id).alias(id), F.col(key).alias("key"), F.col(resource).alias("res"), slot_start(micros(df, t), width).alias("slot"))
    counts = rows.where(F.col("res").isNotNull()).groupBy("key", "slot", "res").agg(F.count(F.lit(1)).alias("n"))
    state = counts.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("in_use"), F.min_by("res", F.struct(-F.col("n"), "res")).alias("modal"),
                                              F.sum("n").alias("total"))
    later = state.select("key", (F.col("slot") + width).alias("slot"), F.col("modal").alias("before"))
    told = state.join(later, ["key", "slot"], "left").select(
        "key", (F.col("slot") + width).alias("slot"), "in_use", "modal", "total", (F.col("modal") != F.col("before")).alias("changed"))
    own = counts.select("key", (F.col("slot") + width).alias("slot"), "res", "n")
    return (rows.join(told, ["key", "slot"], "left").join(own, ["key", "slot", "res"], "left")
            .select(id, F.coalesce("in_use", F.lit(0)).alias("in_use"), "modal", "changed",
                    F.when(F.col("total").isNotNull(), F.coalesce("n", F.lit(0)) / F.col("total")).alias("own_share")))
