"""Days of output that are published in one step.

A job writes its days to a folder of its own, where no reader looks, and then a new manifest: a row for each
published day, with the run that holds it, the schema version and the number of rows. The manifest is
written beside the others under a hidden name and takes its number by one rename that fails if the number is taken.
Before the rename readers see all of the old days, after it all of the new ones. A job that is lost half-way leaves
files that nobody reads (`unread_runs` names them), a job that is repeated under the same run changes nothing, and of two jobs
at once the later one builds on the other's manifest or is told of the clash.

The rename is atomic on HDFS and on mounted folders. On an object store whose rename copies, only one job may publish at a time.
The driver holds the manifest's rows: one for each day, whatever the data.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "day string, run string, version int, n_rows long"
#: Days are words, dates or times without a sign that the writer would escape in a folder's name.
DAY = r"^[A-Za-z0-9 .+_-]+$"
#: Manifests that a job, beaten to a number by another one, builds anew before it gives up.
TRIES = 8


class Folder:
    """A published folder through the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        where = self._at(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = where.getFileSystem(conf)
        self._renamer = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def number(self) -> int:
        """The latest manifest's number; 0 before the first."""
        return max((int(n) for n in self.names("_manifests") if re.fullmatch("[0-9]+", n)), default=0)

    def manifest(self, number: int | None = None) -> DataFrame:
        number = self.number() if number is None else number
        if number == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/_manifests/{number:09d}")

    def take(self, hidden: str, number: int) -> bool:
        """Gives the hidden manifest its number, if that is free."""
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(kind, 0)
        target = self._at(f"{self.path}/_manifests/{number:09d}")
        if self._files.exists(target):
            return False
        try:
            self._renamer.rename(self._at(f"{self.path}/_manifests/{hidden}"), target, none)
        except Exception as problem:
            if "FileAlreadyExistsException" in str(problem):
                return False
            raise
        return True


def _word(run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError(f"a run is named by letters, digits, dot, dash and underscore: {run!r}")
    return run


def publish_days(df: DataFrame, path: str, day: str, run: str, version: int = 1) -> int:
    """Publishes the days that `df` has rows for and returns the manifest's number.

    Days with rows replace what was published for them; others stay as they are, and a day without rows gets no entry. A row
    without a day, or with one that can't name a folder, is refused, as are columns named _run or _day. A run that was published before changes nothing.
    """
    if {"_run", "_day"} & set(df.columns):
        raise ValueError("columns _run and _day belong to the folder")
    folder, spark = Folder(df.sparkSession, path), df.sparkSession
    last = folder.number()
    if last and not spark.read.schema(MANIFEST).json(f"{folder.path}/_manifests/[0-9]*").where(F.col("run") == _word(run)).isEmpty():
        return last
    text = F.col(day).cast("date").cast("string") if dict(df.dtypes)[day].startswith("timestamp") else F.col(day).cast("string")
    named = F.when(text.rlike(DAY), text).otherwise(F.raise_error(F.concat(F.lit("a row has no day that can name a folder: "), F.coalesce(text, F.lit("none")))).cast("string"))
    mine = f"{folder.path}/_run={_word(run)}"
    whole = df.withColumn("_day", named)
    whole.write.mode("overwrite").partitionBy("_day").parquet(mine)
    counts = spark.read.schema(whole.schema).parquet(mine).groupBy(F.col("_day").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    new = counts.select("day", F.lit(run).alias("run"), F.lit(version).alias("version"), "n_rows")
    for _ in range(TRIES):
        last, hidden = folder.number(), f".{uuid.uuid4().hex}"
        kept = folder.manifest(last).join(new.select("day"), "day", "left_anti")
        kept.unionByName(new).coalesce(1).write.json(f"{folder.path}/_manifests/{hidden}")
        if folder.take(hidden, last + 1):
            return last + 1
    raise RuntimeError(f"other jobs keep publishing to {path}; run {run} is written but not published")


def published(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(day, run, version, n_rows) of the latest or a numbered manifest; the done side of `files.todo`."""
    return Folder(spark, path).manifest(number)


def read_published(spark: SparkSession, path: str, number: int | None = None, where: Column | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of all published days, or of those whose manifest rows meet `where`: only their folders are listed.

    With no such day the result is empty and has the given schema; without one that is an error. Runs of
    different schemas need `schema` as well: columns go by name, absent ones are null.
    """
    folder = Folder(spark, path)
    days = folder.manifest(number) if where is None else folder.manifest(number).where(where)
    at = [f"{folder.path}/_run={r['run']}/_day={r['day']}" for r in days.select("day", "run").sort("day").collect()]
    if not at:
        if schema is None:
            raise FileNotFoundError(f"no such day is published in {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*at)


def unread_runs(spark: SparkSession, path: str) -> list[str]:
    """Runs whose files the latest manifest doesn't need: of lost jobs, of jobs at work, or replaced since."""
    folder = Folder(spark, path)
    used = {r[0] for r in folder.manifest().select("run").distinct().collect()}
    return [n.removeprefix("_run=") for n in folder.names("") if n.startswith("_run=") and n.removeprefix("_run=") not in used]
