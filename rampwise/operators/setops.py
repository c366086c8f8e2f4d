"""Joins and set operations with their null rules stated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.functions.clock import micros, slot_start, span
from rampwise.operators.asof import next_after


def join_features(base: DataFrame, tables: Sequence[DataFrame], id: str) -> DataFrame:
    """Left join of feature tables on one id; all share its partitioning, so the base moves once."""
    return reduce(lambda left, right: left.join(right, id, "left"), tables, base)


def fallback_lookup(df: DataFrame, tables: Sequence[tuple[Sequence[str], DataFrame, str]],
                    default: float | Column | None, out: str) -> DataFrame:
    """`out` from the first table that knows the row: (keys, table, value column) from fine to coarse.

    No broadcast is asked for: adaptive execution broadcasts a table whose measured size allows it
    and splits hot keys of a sort-merge join otherwise.
    """
    found = df
    names = []
    for i, (keys, table, value) in enumerate(tables):
        names.append(f"_level{i}")
        found = found.join(table.select(*keys, F.col(value).alias(names[-1])), list(keys), "left")
    last = [] if default is None else [default if isinstance(default, Column) else F.lit(default)]
    return found.select(*[df[c] for c in df.columns], F.coalesce(*[F.col(n) for n in names], *last).alias(out))


def join_on_slot(left: DataFrame, right: DataFrame, key: str, lt: str, slot: str, width: float) -> DataFrame:
    """Left join on key and truncated time; `slot` is the right side's slot start in microseconds."""
    placed = left.withColumn(slot, slot_start(micros(left, lt), span(width)))
    return placed.join(right, [key, slot], "left")


def without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `left` whose composite key `right` does not have; a null key is never had."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def difference_counts(template: DataFrame, out: DataFrame, id: str) -> DataFrame:
    """(missing, extra): ids only in the template and only in the output, rows counted; null ids count as absent."""
    missing = template.join(out, id, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return missing.select("missing", out.join(template, id, "left_anti").agg(F.count(F.lit(1))).scalar().alias("extra"))


def membership(df: DataFrame, members: DataFrame, key: str, inside: str, outside: str, out: str) -> DataFrame:
    """Label by whether the key occurs in `members`."""
    known = members.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(True))
    return (df.join(known, key, "left")
            .select(*[df[c] for c in df.columns], F.when(F.col("_in"), inside).otherwise(outside).alias(out)))


def with_offsets(df: DataFrame, values: Sequence, out: str) -> DataFrame:
    """Each row once per value of a short fixed list."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(v) for v in values])))


def typed_union(branches: Sequence[DataFrame], missing: bool = True) -> DataFrame:
    """UNION ALL by column name; a branch's absent column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), branches)


def reoccupied(intervals: DataFrame, events: DataFrame, key: str, id: str, start: str, end: str, at: str,
               width: float = 86400) -> DataFrame:
    """(id, taken, lead): whether an event of the key falls inside (start, end), and seconds from the
    first such event to the end.

    Only the first event after the start matters, so this is a search for the next instant rather
    than a join of all pairs.
    """
    spans = intervals.select(F.col(key).alias("k"), micros(intervals, start).alias("t"),
                             micros(intervals, end).alias("e"), F.col(id).alias(id))
    marks = events.select(F.col(key).alias("k"), micros(events, at).alias("t"))
    found = next_after(spans, marks, ["k"], "t", "t", [], slot=span(width))
    taken = F.col("next_t").isNotNull() & (F.col("next_t") < F.col("e"))
    return found.select(id, F.coalesce(taken, F.lit(False)).alias("taken"),
                        F.when(taken, (F.col("e") - F.col("next_t")) / 1_000_000).alias("lead"))
