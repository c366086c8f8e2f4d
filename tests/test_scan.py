"""Two-level scans with small blocks against ordinary windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rampwise.bindings.registry import ev
from rampwise.operators import diagnose, evaluate
from rampwise.operators.quantiles import exact_quantiles, ordered_distribution
from rampwise.operators.scan import neighbours, running_sums, tie_rank
from tests.conftest import rows


def test_running_sums(spark, data):
    e = ev(spark, data).withColumn("blk", F.floor(F.col("t") / 3_600_000_000))
    w = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = e.withColumn("run_k", F.sum("k").over(w))
    assert rows(running_sums(e, ["key"], "blk", ["t"], ["k"]), "id", "run_k") == rows(want, "id", "run_k")


def test_neighbours(spark, data):
    e = ev(spark, data).withColumn("blk", F.floor(F.col("t") / 3_600_000_000))
    w = Window.partitionBy("key").orderBy("t")
    want = e.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    got = neighbours(e, ["key"], "blk", ["t"], ["id"]).select("id", F.col("prev.id").alias("p"), F.col("next.id").alias("n"))
    assert rows(got) == rows(want)


def test_tie_rank(spark, data):
    e = ev(spark, data)
    w = Window.partitionBy("kind").orderBy("id")
    want = e.select("id", F.row_number().over(w).cast("long").alias("tie_rank"))
    assert rows(tie_rank(e, ["kind"], "id", width=50), "id", "tie_rank") == rows(want)


def test_quantiles_equal_sorted_ones(spark, data):
    e = ev(spark, data).withColumn("val", F.when(F.col("id") % 9 != 0, F.col("val")))
    probs = {"low": 0.0, "med": 0.5, "p90": 0.9, "top": 1.0}
    want = e.groupBy("kind").agg(F.count("val").alias("n"), *[F.percentile("val", p).alias(q) for q, p in probs.items()])
    got = exact_quantiles(e, ["kind"], "val", probs)
    close = got.join(want.withColumnsRenamed({q: f"w_{q}" for q in ["n", *probs]}), "kind")
    assert close.count() == 5
    assert all(close.where(F.abs(F.col(q) - F.col(f"w_{q}")) > 1e-9).count() == 0 for q in ["n", *probs])


def test_quantiles_of_null_groups_and_of_everything(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None), ("a", float("nan"))], "g string, v double")
    assert rows(exact_quantiles(df, ["g"], "v", {"m": 0.5})) == [("a", 1, 5.0), (None, 2, 2.0)]
    assert rows(exact_quantiles(df, [], "v", {"m": 0.5})) == [(3, 3.0)]
    assert rows(exact_quantiles(df.where("v < 0"), [], "v", {"m": 0.5})) == []


def test_orders_leave_nan_out_and_keep_large_numbers_apart(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2), (1, 0.3), (0, float("nan")), (1, None)], "y int, s double")
    got = diagnose.auc(df, "s", F.col("y") == 1).first()
    assert (got["positives"], got["negatives"], got["auc"]) == (2, 1, 0.5)
    assert evaluate.pareto(df, F.col("s"), [1]).first()["share"] == pytest.approx(0.5)
    big = spark.createDataFrame([(2**60,), (2**60 + 1,)], "v long")
    assert rows(ordered_distribution(big, "v"), "v", "run_n") == [(2**60, 1), (2**60 + 1, 2)]


def test_ordered_distribution(spark, data):
    e = ev(spark, data)
    got = ordered_distribution(e, "k", {"s": F.col("id")}, descending=True, blocks=7)
    w = Window.orderBy(F.desc("k"))
    want = e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).select(
        "k", "n", "s", F.sum("n").over(w).alias("run_n"), F.sum("s").over(w).alias("run_s"))
    assert rows(got) == rows(want)


def test_quantiles_take_one_join_and_cut_groups_anywhere(spark):
    """A group that many ranges share, groups of null keys, and a single join for what lies before a range and a group's size."""
    hot = [("h", None, float(i % 700)) for i in range(3000)]
    few = [(None, 1, 4.0), (None, 1, 6.0), (None, None, 1.0), ("h", 1, float("nan")), ("h", 1, None), ("h", 1, 2.0)]
    df = spark.createDataFrame(hot + few, "a string, b int, v double")
    made = exact_quantiles(df, ["a", "b"], "v", {"m": 0.5, "top": 1.0})
    assert made.columns == ["a", "b", "n", "m", "top"]
    mid = sorted(v for _, _, v in hot)[1499:1501]
    assert {tuple(r) for r in made.collect()} == {("h", None, 3000, sum(mid) / 2, 699.0), (None, 1, 2, 5.0, 6.0), (None, None, 1, 1.0, 1.0), ("h", 1, 1, 2.0, 2.0)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
