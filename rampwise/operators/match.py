"""Entity matching: alternative keys, bounded time differences, one accepted candidate."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _slot(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def _spread(right: DataFrame, at: Column, width: float, reach: float, out: str) -> DataFrame:
    """The right side once in each slot that its reach touches."""
    return right.withColumn(out, F.explode(F.sequence(_slot(at - F.lit(reach), width), _slot(at + F.lit(reach), width))))


def match_any_key(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, int]], right_key: str,
                  on: Sequence[str], lt: str, at: Column, width: float, reach: float | None = None) -> DataFrame:
    """Pairs that agree on `on` and on any of the left keys, with times `lt` and `at` at most
    `reach` (`width` where none is given) apart, tagged with the smallest kind.

    Each left row stands once per *different* key it has, so one equi join answers all keys and a
    pair appears once.  The slot of time is part of the join key: a key that many rows share is
    spread over time and never paired as a whole. A right row is copied only to the slots its reach touches.
    """
    reach = width if reach is None else reach
    items, earlier = [], []
    for column, kind in keys:
        fresh = F.col(column).isNotNull()
        for other in earlier:
            fresh = fresh & ~F.col(column).eqNullSafe(F.col(other))
        items.append(F.when(fresh, F.struct(F.col(column).alias("key"), F.lit(kind).cast("long").alias("kind"))))
        earlier.append(column)
    rows = left.withColumn("_k", F.explode(F.array_compact(F.array(*items)))).select(
        *left.columns, F.col("_k.key").alias("_key"), F.col("_k.kind").alias("kind"))
    rows = rows.withColumn("_slot", _slot(F.col(lt), width))
    held = right.where(F.col(right_key).isNotNull()).withColumns({"_key": F.col(right_key), "_at": at})
    other = _spread(held.where(F.col("_at").isNotNull()), F.col("_at"), width, reach, "_slot")
    return (rows.join(other, [*on, "_key", "_slot"]).where(F.abs(F.col("_at") - F.col(lt)) <= reach)
            .drop("_key", "_slot", "_at"))


def within_reach(pairs: DataFrame, lt: str, rt: str, last: str, tol: float = 180, after: float = 360,
                 penalty: float = 60) -> DataFrame:
    """Pairs with abs(rt - lt) <= tol; without rt, those with lt at most `after` past `last`.

    `dist` is the difference used; the second form pays `penalty`.
    """
    direct = F.abs(F.col(rt) - F.col(lt))
    since = F.col(lt) - F.col(last)
    keep = (F.col(rt).isNotNull() & (direct <= tol)) | (F.col(rt).isNull() & since.between(0, after))
    return pairs.where(keep).withColumn("dist", F.coalesce(direct, F.abs(since) + penalty).cast("double"))


def match_bucketed(left: DataFrame, right: DataFrame, on: Sequence[str], lt: str, rt: str, tol: float = 90,
                   width: float = 600, kind: int = 4) -> DataFrame:
    """Pairs equal in `on` with abs(rt - lt) <= tol: an equi join on slots of `width` >= tol."""
    if width < tol:
        raise ValueError("width must not be below tol")
    rows = left.withColumn("_slot", _slot(F.col(lt), width))
    for k in on:
        rows, right = rows.where(F.col(k).isNotNull()), right.where(F.col(k).isNotNull())
    other = _spread(right.where(F.col(rt).isNotNull()), F.col(rt), width, tol, "_slot")
    gap = F.abs(F.col(rt) - F.col(lt)).cast("double")
    return (rows.join(other, [*on, "_slot"]).where(gap <= tol).drop("_slot")
            .withColumns({"kind": F.lit(kind).cast("long"), "dist": gap}))


def collapse(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """A pair reached by several keys counts once, with its smallest kind and distance."""
    rest = [c for c in pairs.columns if c not in (left_id, right_id, "kind", "dist")]
    held = pairs.groupBy(left_id, right_id).agg(
        F.min("kind").alias("kind"), F.min("dist").alias("dist"),
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct("kind", "dist")).alias("_r"))
    return held.select(left_id, right_id, "kind", "dist", *[F.col(f"_r.{c}").alias(c) for c in rest])


def accept(pairs: DataFrame, id: str, tie: str, unique_kinds: Collection[int] = (4,)) -> DataFrame:
    """The best pair per id by (kind, dist, tie).

    A best pair of a kind in `unique_kinds` stands only if the id has exactly one pair of those
    kinds.  An aggregate rather than a ranking, so pairs are reduced before they move.
    """
    rest = [c for c in pairs.columns if c != id]
    weak = F.col("kind").isin(list(unique_kinds))
    best = pairs.groupBy(id).agg(F.min_by(F.struct(*rest), F.struct("kind", "dist", tie)).alias("_b"),
                                 F.count_if(weak).alias("_weak"))
    return (best.where(~F.col("_b.kind").isin(list(unique_kinds)) | (F.col("_weak") == 1))
            .select(id, *[F.col(f"_b.{c}").alias(c) for c in rest]))
