"""Exact quantiles and ordered distributions without a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.operators.scan import PAST, running_sums
from rampwise.session import pinned


def known(value: str | Column, kind: str = "double") -> Column:
    """Neither null nor NaN: what quantiles and orders look at."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNotNull() & ~F.isnan(c.cast("double")) if kind in ("double", "float") else c.isNotNull()


def _in_ranges(counts: DataFrame, *order: Column, blocks: int | None = None) -> DataFrame:
    """The rows dealt to ranges of their order, with the range's number `_block`; written once, so that each later use sees the same ranges."""
    dealt = counts.repartitionByRange(*order) if blocks is None else counts.repartitionByRange(blocks, *order)
    return pinned(dealt.withColumn("_block", F.spark_partition_id()))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """(keys, n, one column per quantile), interpolated, nulls and NaN skipped.

    The rows are reduced once to (keys, value, count). These are dealt to ranges of (keys, value) and
    counted in two levels, within a range and over the ranges before, so a group of any size is spread over tasks.
    """
    names = list(probs)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(known("_v"))
    counts = _in_ranges(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), *[F.col(k) for k in keys], F.col("_v"))
    group = ["_k"] if keys else []  # null is a group too, but only as part of a struct equal in a join
    counts = counts.select(*[F.struct(*keys).alias(k) for k in group], "_block", "_v", "_c")
    # One small row per group and range brings what lies before the range and the group's size at once.
    totals = counts.groupBy(*group, "_block").agg(F.sum("_c").alias("_t"))
    whole = Window.partitionBy(*group)
    placed = totals.select(*group, "_block", F.sum("_t").over(whole).alias("n"),
                           F.coalesce(F.sum("_t").over(whole.orderBy("_block").rowsBetween(PAST, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_block").orderBy("_v").rowsBetween(PAST, 0)
    local = counts.withColumn("_in", F.sum("_c").over(inside))
    upto = local.join(placed, [*group, "_block"]).withColumn("run__c", F.col("_in") + F.col("_before"))
    made: list[Column] = []
    for q in names:
        place = F.lit(float(probs[q])) * (F.col("n") - 1)
        at = lambda k: F.max(F.when((F.col("run__c") > k) & (F.col("run__c") - F.col("_c") <= k), F.col("_v")))
        a, b, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        made.append((a + (b - a) * part).alias(q))
    found = upto.groupBy(*group).agg(F.max("n").alias("n"), *made).where("n IS NOT NULL")
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], "n", *names)


def quantile_levels(df: DataFrame, levels: Sequence[Sequence[str]], value: str, probs: Mapping[str, float]) -> list[DataFrame]:
    """(keys, n, one column per quantile) for each level; no keys at all are a level too.

    All levels are one table whose groups begin with the level's number, so they share one dealing to ranges and one count.
    """
    every = list(dict.fromkeys(k for keys in levels for k in keys))
    kind = {k: df.schema[k].dataType for k in every}
    parts = [F.struct(F.lit(i).alias("_level"), *[(F.col(k) if k in keys else F.lit(None)).cast(kind[k]).alias(k) for k in every]) for i, keys in enumerate(levels)]
    long = df.select(F.col(value).cast("double").alias("_value"), F.explode(F.array(*parts)).alias("x")).select("x.*", "_value")
    held = pinned(exact_quantiles(long, ["_level", *every], "_value", probs))
    return [held.where(F.col("_level") == i).select(*keys, "n", *probs) for i, keys in enumerate(levels)]


def medians(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """(keys, one exact median per named value), nulls skipped."""
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("what"), c.cast("double").alias("v")) for n, c in values.items()])).alias("x")).select(*keys, "x.*")
    held = exact_quantiles(long, [*keys, "what"], "v", {"m": 0.5})
    return held.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == n, F.col("m"))).alias(n) for n in values])


def ordered_distribution(df: DataFrame, value: str, sums: Mapping[str, Column] | None = None,
                         descending: bool = False, blocks: int | None = None) -> DataFrame:
    """One row per distinct value: n, the sums, and their inclusive running totals run_<name>; nulls and NaN are left out.

    The order is global: values are dealt to ranges, as many as the session has shuffle partitions, and summed in two levels.
    """
    sums = dict(sums or {})
    kind = dict(df.dtypes)[value]
    counts = df.where(known(value, kind)).groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    order = F.col(value).desc() if descending else F.col(value).asc()
    placed = _in_ranges(counts, order, blocks=blocks)
    return running_sums(placed, [], "_block", [order], ["n", *sums]).drop("_block")
