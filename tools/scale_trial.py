"""Time jobs on an event table enlarged by shifted copies: scale_trial.py COPIES name ..."""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from rampwise.bindings import catalog  # noqa: E402
from rampwise.session import local_session  # noqa: E402

SOURCE = "/root/testdata/sf0.1"


def main() -> None:
    copies, names = int(sys.argv[1]), sys.argv[2:]
    spark = local_session("scale", partitions=int(os.environ.get("PARTITIONS", "32")))
    d = os.environ.get("TRIAL_DIR") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not os.path.exists(f"{d}/events.parquet"):
        e = spark.read.parquet(f"{SOURCE}/events.parquet")
        n = e.count()
        many = e.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
            (F.col("event_id") + F.col("copy") * n).alias("event_id"),
            (F.col("ts") + F.make_dt_interval(F.col("copy") * 30)).alias("ts"), "user_id", "event_type", "value", "props")
        many.repartition(16).write.parquet(f"{d}/events.parquet")
    print(d, spark.read.parquet(f"{d}/events.parquet").count(), "events", flush=True)
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        print(f"{time.perf_counter() - t0:8.1f} s  {name}", flush=True)


if __name__ == "__main__":
    main()
