"""Ordered scans that never need a whole key in one task.

A running value per key is split in two: inside a block (a slice of the key's
order) by an ordinary window, and across blocks through a table with one row per
(key, block).  The block is a monotone function of the order, so the two parts
add up exactly.  Callers choose blocks whose size has a bound of its own: a day
of distinct instants, or a fixed range of ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAST = Window.unboundedPreceding


def running_sums(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str | Column],
                 values: Sequence[str], prefix: str = "run_") -> DataFrame:
    """Inclusive running sum of each of `values` per key, in `order`."""
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(PAST, 0)
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(PAST, -1)
    totals = df.groupBy(*keys, block).agg(*[F.sum(v).alias(v) for v in values])
    before = totals.select(*keys, block, *[
        F.coalesce(F.sum(v).over(across), F.lit(0)).alias(f"_before_{v}") for v in values])
    local = df.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    joined = local.join(before, [*keys, block], "left")
    out = joined.select(*df.columns, *[
        (F.col(f"_in_{v}") + F.col(f"_before_{v}")).alias(f"{prefix}{v}") for v in values])
    return out


def neighbours(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
               columns: Sequence[str], previous: str | None = "prev",
               following: str | None = "next") -> DataFrame:
    """The row before and the row after, as structs of `columns`."""
    row = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(*[F.col(o) for o in order])
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(block)
    edges = df.groupBy(*keys, block).agg(F.min_by(row, rank).alias("_first"),
                                         F.max_by(row, rank).alias("_last"))
    beyond = edges.select(*keys, block, F.lag("_last").over(across).alias("_lag"),
                          F.lead("_first").over(across).alias("_lead"))
    local = df.select("*", F.lag(row).over(inside).alias("_p"), F.lead(row).over(inside).alias("_n"))
    made: list[Column] = []
    if previous:
        made.append(F.coalesce("_p", "_lag").alias(previous))
    if following:
        made.append(F.coalesce("_n", "_lead").alias(following))
    return local.join(beyond, [*keys, block], "left").select(*df.columns, *made)


def tie_rank(df: DataFrame, keys: Sequence[str], id: str, out: str = "tie_rank",
             width: int = 1_000_000, source: DataFrame | None = None) -> DataFrame:
    """1-based position by numeric `id` among rows equal in `keys`; null where a key is.

    Blocks are ranges of ids, so a block of unique ids holds `width` rows at most
    even if a single instant holds a third of the table.  `source` holds the same keys and ids
    as `df` where they are cheaper to read.
    """
    blocked = df.withColumn("_idblock", F.floor(F.col(id) / width))
    inside = Window.partitionBy(*keys, "_idblock").orderBy(id)
    across = Window.partitionBy(*keys).orderBy("_idblock").rowsBetween(PAST, -1)
    before = ((df if source is None else source).groupBy(*keys, F.floor(F.col(id) / width).alias("_idblock"))
              .agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, "_idblock", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_below")))
    return (blocked.withColumn("_pos", F.row_number().over(inside))
            .join(before, [*keys, "_idblock"], "left")
            .select(*df.columns, (F.col("_pos") + F.col("_below")).cast("long").alias(out)))
