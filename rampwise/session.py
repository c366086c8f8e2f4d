"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def local_session(app: str = "rampwise", cores: str | int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites per column cost more than the plan
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """All instants are read as UTC, whatever the session came with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`.

    Only a local session that names none (tests, local runs) gets one made, for as long as the process lives.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="rampwise-"))
            atexit.register(shutil.rmtree, _local[0], True)
        named = _local[0]
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read again: what needs a few columns of them reads those alone."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send_source(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once a context: functions that run in Python workers import it."""
    sc = spark.sparkContext
    if getattr(sc, "_rampwise_sent", None) is None:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="rampwise-source-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "rampwise_source.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(os.path.join(root, "rampwise")):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
        sc.addPyFile(path)
        sc._rampwise_sent = path
    return spark
