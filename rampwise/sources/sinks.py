"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, by: str | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def save_features(df: DataFrame, name: str, id: str, buckets: int = 64) -> None:
    """Replace a keyed feature table, bucketed and sorted by id so that later joins need no shuffle.

    Rows are dealt to their bucket first: one writer per bucket, one file each.
    """
    (df.repartition(buckets, id).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, id).sortBy(id).saveAsTable(name))


def write_if_any(df: DataFrame, path: str, day: str) -> str:
    """Rewrite only the days that have rows; a day without rows leaves no folder behind."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))
    return path


def fill_template(template: DataFrame, predictions: DataFrame, id: str, value: str,
                  default: float | Column, as_int: bool = True) -> DataFrame:
    """Every template row once with its prediction, or the default where there is none."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    filled = F.coalesce(F.col(value).cast("double"), fallback.cast("double"))
    out = F.round(filled).cast("int") if as_int else filled
    return (template.select(id).join(predictions.select(id, value), id, "left")
            .select(id, out.alias(value)))
