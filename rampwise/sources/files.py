"""Scans, schema evolution, column audit and work lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def scan(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet from one path, a glob, or a list of both."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def split_files(df: DataFrame, month: str, held_out: Sequence) -> tuple[DataFrame, DataFrame]:
    """(fit, held out) by a month column; on a partition column both prune at planning."""
    inside = F.col(month).isin(*held_out)
    return df.where(~inside), df.where(inside)


def scan_evolving(spark: SparkSession, paths: str | Sequence[str], optional: Mapping[str, str]) -> DataFrame:
    """Files of several schema versions by column name; an optional column no file has is null."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    missing = {c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def scan_csv_lenient(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """All-text CSV; rows that do not fit the columns are left out.

    A malformed row is only seen if every column is parsed, so pruning is off for this scan.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.read.option("columnPruning", "false")
            .csv(path, schema=schema, header=header, mode="DROPMALFORMED", enforceSchema=True))


def audit_columns(df: DataFrame, tokens: Sequence[str], where: Column | None = None) -> DataFrame:
    """(column, filled, total, share) of every column whose name holds a token, in one pass."""
    chosen = [c for c in df.columns if any(t.upper() in c.upper() for t in tokens)]
    rows = df if where is None else df.where(where)
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(c)).alias(c) for c in chosen])
    return (counts.unpivot(["total"], chosen, "column", "filled")
            .select("column", "filled", "total", F.try_divide("filled", "total").alias("share")))


def days_of(df: DataFrame, ts: str, where: Column | None = None) -> DataFrame:
    """Distinct days, in order."""
    rows = df if where is None else df.where(where)
    return rows.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("day")).distinct().orderBy("day")


def todo(wanted: DataFrame, done: DataFrame, version: int, order: Sequence[Column] = ()) -> DataFrame:
    """Wanted days without an output of the current schema version, in order of priority."""
    finished = done.where(F.col("version") >= version).select("day").distinct()
    left = wanted.select("day").distinct().join(finished, "day", "left_anti")
    return left.orderBy(*order, "day")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, change, old tag, new tag) for objects modified, added or removed."""
    a = old.select(F.col(key), F.col(tag).alias(f"old_{tag}"), F.lit(True).alias("_old"))
    b = new.select(F.col(key), F.col(tag).alias(f"new_{tag}"), F.lit(True).alias("_new"))
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(~F.col(f"old_{tag}").eqNullSafe(F.col(f"new_{tag}")), "modified"))
    return (a.join(b, key, "full").withColumn("change", change).where(F.col("change").isNotNull())
            .select(key, "change", f"old_{tag}", f"new_{tag}"))


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A manifest of a folder: path, size, modification time; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def labelled(df: DataFrame, phase: str, target: str, value: str = "DEP") -> DataFrame:
    """Rows of the phase with a known, positive target."""
    return df.where((F.col(phase) == value) & F.col(target).isNotNull() & (F.col(target) > 0))


