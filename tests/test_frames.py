"""Frames and running values: ties, edges, empty frames, and the scaled form against the plain one."""

import pytest
from pyspark.sql import functions as F

from rampwise.bindings.registry import ev, iv
from rampwise.operators import asof, occupancy, trailing
from rampwise.operators.frames import Frame, Measure, Running, instant_frames
from tests.conftest import rows

S = 1_000_000
HOUR = 3600 * S


def test_trailing_counts_include_ties_and_both_ends(spark):
    events = spark.createDataFrame([("a", 0, "x"), ("a", 900 * S, "x"), ("a", 900 * S, "x"), ("a", 901 * S, "y"), ("b", 900 * S, "x")],
                                   "key string, t long, kind string")
    probes = spark.createDataFrame([(1, "a", 900 * S), (2, "a", 900 * S + 1), (3, "c", 5), (4, "a", None)], "id long, key string, t long")
    out = trailing.trailing_counts(events, probes, "key", "t", "kind", ["x", "y"], "id", (900,))
    assert rows(out, "id", "x_prev15", "y_prev15") == [(1, 3, 0), (2, 2, 0), (3, 0, 0)]


def test_trailing_means_stop_one_second_before(spark):
    events = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 3599 * S, "x", 3.0), ("a", 3600 * S, "x", 100.0)],
                                   "key string, t long, kind string, v double")
    probes = spark.createDataFrame([(1, "a", 3600 * S), (2, "a", 3600 * S + 1), (3, "a", 0)], "id long, key string, t long")
    out = trailing.trailing_means(events, probes, "key", "t", "kind", "v", ["x"], "id")
    assert rows(out, "id", "x_mean60") == [(1, 2.0), (2, 3.0), (3, None)]


def test_nowcast_leaves_incomplete_rows_out(spark):
    df = spark.createDataFrame([(1, "a", 0, 2.0, 1.0), (2, "a", 10 * S, 4.0, None), (3, "a", 20 * S, -6.0, 1.0)],
                               "id long, key string, t long, u double, v double")
    out = trailing.nowcast(df, "key", "t", ["u", "v"], "id", (60,))
    assert rows(out, "id", "n1", "u_mean1", "u_absmean1") == [(1, 0, None, None), (3, 1, 2.0, 2.0)]


def test_centred_count_counts_itself(spark):
    df = spark.createDataFrame([(i, "a", t * S) for i, t in enumerate([0, 1800, 3600, 3601])], "id long, key string, t long")
    assert rows(trailing.centred_count(df, "key", "t", "id"), "id", "around") == [(0, 2), (1, 3), (2, 3), (3, 2)]


def test_occupancy_tie_rules(spark):
    spans = spark.createDataFrame([
        (1, "a", 0, 10), (2, "a", 10, 20), (3, "a", 10, 30), (4, "a", 20, 20), (5, "a", None, 25), (6, "a", 29, 40), (7, None, 1, 2)],
        "id long, key string, s long, e long")
    # 1 ends as 2 and 3 start; 4 has no length; 5 has no start.
    want = [(1, 0), (2, 0), (3, 1), (6, 1)]
    assert rows(occupancy.occupancy(spans, "key", "s", "e", "id"), "id", "occupancy") == want
    assert rows(occupancy.occupancy(spans, "key", "s", "e", "id", form="plain").where("id < 7"), "id", "occupancy") == want
    probes = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (3, "a", 30), (4, "a", 100), (5, "z", 1)], "id long, key string, t long")
    assert rows(occupancy.occupancy_at(probes, spans, "key", "t", "s", "e", "id"), "id", "occupancy") == [
        (1, 0), (2, 2), (3, 1), (4, 0), (5, 0)]


def test_occupancy_equals_interval_count(spark, data):
    spans = iv(spark, data).where("s < e")
    got = {r["t"]: r["occupancy"] for r in occupancy.occupancy_at(
        spans.select("key", F.col("s").alias("t"), F.col("s").alias("id")).where("key = '5-LOW'").distinct(),
        spans, "key", "t", "s", "e", "id").select(F.col("id").alias("t"), "occupancy").collect()}
    held = [(r["s"], r["e"]) for r in spans.where("key = '5-LOW'").collect()]
    assert got and all(n == sum(1 for s, e in held if s < t < e) for t, n in got.items())
    assert min(got.values()) >= 0


@pytest.mark.parametrize("form", ["plain", "scaled"])
def test_asof_takes_equal_instants_and_the_largest_tie(spark, form):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 99), (3, "b", 5), (4, None, 5), (5, "a", 5 * 86_400 * S)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 100, 7, 1), ("a", 100, 9, 2), ("a", 50, 1, 3), ("b", 6, 1, 4), ("a", None, 1, 5)],
                                  "k string, t long, v long, n long")
    out = asof.asof_left(left, right, ["k"], "t", "t", ["v"], tie="n", form=form)
    assert rows(out, "id", "asof_t", "v") == [(1, 100, 9), (2, 50, 1), (3, None, None), (4, None, None), (5, 100, 9)]


def test_next_after_is_strict(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (3, "a", 13)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 10, 1), ("a", 12, 2), ("a", 13, 3)], "k string, t long, v long")
    assert rows(asof.next_after(left, right, ["k"], "t", "t", ["v"], slot=5), "id", "next_t", "v") == [(1, 12, 2), (2, 12, 2), (3, None, None)]


def test_scaled_forms_equal_plain_forms(spark, data):
    e = ev(spark, data)
    clicks = e.where("kind = 'click'")
    kinds = ["view", "purchase"]
    make = {
        "counts": lambda f: trailing.trailing_counts(e, clicks, "key", "t", "kind", kinds, "id", form=f),
        "means": lambda f: trailing.trailing_means(e.withColumn("val", F.col("k")), clicks, "key", "t", "kind", "val", kinds, "id", 7200, form=f),
        "nowcast": lambda f: trailing.nowcast(e, "key", "t", ["k"], "id", form=f),
        "around": lambda f: trailing.centred_count(e, "key", "t", "id", 7000, 3000, form=f),
        "last": lambda f: trailing.last_when(e, "key", "t", F.col("k") > 95, form=f),
        "rolling": lambda f: trailing.rolling(e, "key", "t", {"m": ("min", F.col("k"), 9000), "s": ("sum", F.col("k"), 900)}, form=f),
        "asof": lambda f: asof.asof_left(clicks, e.where("k > 90").withColumnRenamed("id", "rid"), ["key"], "t", "t", ["rid"], "rid", form=f),
        "occupancy": lambda f: occupancy.occupancy(iv(spark, data).dropDuplicates(["id"]), "key", "s", "e", "id", form=f),
    }
    for name, df in make.items():
        want = rows(df("plain"))
        assert want == rows(df("scaled")), name
        assert want == rows(df("fine")), name


def test_running_values_cross_slots_with_and_without_frames(spark):
    df = spark.createDataFrame([("a", t, 1) for t in (0, 5, 10, 25, 25, 99)], "key string, t long, n long")
    run = [Running("upto", "s"), Running("before", "s", exclusive=True)]
    want = [(0, 1, 0), (5, 2, 1), (10, 3, 2), (25, 5, 3), (99, 6, 5)]
    for frames in ([], [Frame("f", "s", -7, 0)]):
        out = instant_frames(df, ["key"], "t", [Measure("s", F.col("n"))], frames, run, slot=10)
        assert rows(out, "t", "upto", "before") == want


def test_one_hot_instant(spark):
    """A third of all rows at one instant of one key: still exact, and one row per instant in the window."""
    events = spark.range(3000).select(F.lit("a").alias("key"), F.when(F.col("id") < 1000, F.lit(HOUR)).otherwise(F.col("id") * S).alias("t"),
                                      F.lit("x").alias("kind"), "id")
    out = trailing.trailing_counts(events, events.where("id < 1000"), "key", "t", "kind", ["x"], "id", (60,))
    assert out.select("x_prev1").distinct().count() == 1
    assert out.count() == 1000
    queue = occupancy.occupancy(events.withColumn("e", F.lit(10 * HOUR)), "key", "t", "e", "id")
    hot = [r[0] for r in queue.where("id < 1000").orderBy("id").select("occupancy").collect()]
    assert hot == list(range(hot[0], hot[0] + 1000))


@pytest.mark.parametrize("form", ["scaled", "fine"])
def test_frames_only_ever_grow(spark, form):
    """No window frame slides: with sliding ones each row of a dense key summed its whole frame anew."""
    df = spark.range(200).select(F.lit("a").alias("key"), (F.col("id") * 7 * S).alias("t"), F.col("id").cast("double").alias("v"))
    frames = [Frame("trail", "s", -60 * S, 0), Frame("gap", "s", -60 * S, -S), Frame("low", "m", -30 * S, 0), Frame("around", "s", -20 * S, 10 * S),
              Frame("ahead", "m", 5 * S, 90 * S), Frame("far", "s", -600 * S, -500 * S)]
    measures = [Measure("s", F.col("v")), Measure("m", F.col("v"), "min")]
    out = instant_frames(df, ["key"], "t", measures, frames, form=form)
    assert rows(out) == rows(instant_frames(df, ["key"], "t", measures, frames, form="plain"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    specs = plan.split("specifiedwindowframe(")[1:]
    assert specs and all(s.split(",")[1].strip().startswith("unboundedpreceding") for s in specs)
