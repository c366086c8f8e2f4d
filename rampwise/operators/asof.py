"""As-of joins: the latest right row at or before a left row, and the next one after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.functions.clock import MINUTE, micros
from rampwise.operators.frames import Measure, Running, instant_frames


def _search(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, hit: str, exclusive: bool, form: str,
            slot: int) -> DataFrame:
    """(keys, t, found): the largest `hit` over the key's instants up to each left instant."""
    have = right.select(*keys, t, hit, F.lit(False).alias("_ask"))
    ask = left.select(*keys, t, F.lit(None).cast(right.schema[hit].dataType).alias(hit), F.lit(True).alias("_ask"))
    return instant_frames(have.unionByName(ask), keys, t, [Measure(hit, F.col(hit), "max")],
                          running=[Running("found", hit, exclusive)], asks=F.col("_ask"), form=form, slot=slot)


def asof_left(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str,
              bring: Sequence[str], tie: str | None = None, form: str = "scaled", slot: int = MINUTE) -> DataFrame:
    """Every left row plus `bring` and `asof_t` (microseconds) of its latest right row.

    Of right rows at one instant the largest `tie` wins.  Only distinct instants are searched; the answer
    is joined to the left rows.
    """
    order = [F.col(tie).alias("_tie")] if tie else []
    have = right.withColumn("_t", micros(right, rt)).withColumn(
        "_hit", F.struct(F.col("_t").alias("asof_t"), *order, *[F.col(c) for c in bring])).where(F.col("_t").isNotNull())
    seek = left.withColumn("_t", micros(left, lt))
    answers = _search(seek, have, keys, "_t", "_hit", False, form, slot)
    return (seek.join(answers, [*keys, "_t"], "left")
            .select(*[seek[c] for c in left.columns], F.col("found.asof_t").alias("asof_t"),
                    *[F.col(f"found.{c}").alias(c) for c in bring]))


def next_after(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, bring: Sequence[str],
               form: str = "scaled", slot: int = MINUTE) -> DataFrame:
    """Every left row plus `bring` and `next_t` of the first right row strictly after it: the same search,
    time reversed."""
    have = right.withColumn("_t", -micros(right, rt)).withColumn(
        "_hit", F.struct("_t", *[F.col(c) for c in bring])).where(F.col("_t").isNotNull())
    seek = left.withColumn("_t", -micros(left, lt))
    answers = _search(seek, have, keys, "_t", "_hit", True, form, slot)
    return (seek.join(answers, [*keys, "_t"], "left")
            .select(*[seek[c] for c in left.columns], (-F.col("found._t")).alias("next_t"),
                    *[F.col(f"found.{c}").alias(c) for c in bring]))
