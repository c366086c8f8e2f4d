"""Leakage, gates and evaluation rules that the oracles do not isolate."""

import math

from pyspark.sql import functions as F

from rampwise.bindings.registry import movements
from rampwise.functions import scalars as S
from rampwise.operators import evaluate, setops
from rampwise.plans import departures, traces, weather
from rampwise.sources import files, sinks
from rampwise.sources.traces import scan_traces
from tests.conftest import rows


def test_blanking_starts_and_targets_of_departures_changes_no_feature(spark, data):
    raw = movements(spark, data)
    dep = F.col("PHASE_mvt") == "DEP"
    blank = raw.withColumns({c: F.when(~dep, F.col(c)) for c in ("BLOCK_TIME_UTC_mvt", "TAXITIME_SEC_mvt")})
    a = departures.departure_features(departures.canonical(raw), with_target=False)
    b = departures.departure_features(departures.canonical(blank), with_target=False)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_features_plain_and_scaled_agree(spark, data):
    mv = departures.canonical(movements(spark, data))
    exact = lambda f: departures.departure_features(mv, form=f).select(
        "id", "dep_queue", "arr_queue", "takeoff_prev15", "landing_prev60", "plan_n60", "sched_dep_60", "turnaround_sec")
    assert exact("plain").exceptAll(exact("scaled")).count() == 0
    assert exact("plain").exceptAll(exact("fine")).count() == 0


def test_weather_age_counts_minute_boundaries(spark):
    obs = spark.sql("""SELECT 'A' AS site, TIMESTAMP '2025-01-01 00:00:59' AS t, -1.0 AS temp_c, -2.0 AS dewp_c, 1.0 AS vis_mi,
                              5.0 AS wind_kt, CAST(NULL AS DOUBLE) AS precip_in, 'SN' AS wx""")
    moves = spark.sql("""SELECT 1L AS id, 'A' AS site, TIMESTAMP '2025-01-01 01:30:59' AS fin UNION ALL
                         SELECT 2L, 'A', TIMESTAMP '2025-01-01 01:31:00' UNION ALL SELECT 3L, 'A', TIMESTAMP '2025-01-01 00:00:58'""")
    out = weather.weather_features(moves, obs)
    # 90 boundaries are fresh, 91 are not; never above freezing reads 240 hours.
    assert rows(out, "id", "wx_temp_c", "wx_snow", "wx_deice_risk", "wx_hrs_since_thaw") == [
        (1, -1.0, 1, 1, 240.0), (2, None, None, None, None), (3, None, None, None, None)]


def test_reports_are_parsed_with_sentinels(spark):
    raw = spark.createDataFrame([("A", "2025-01-01 00:50", "3.5", "M", "0.2", "x", "1", "T", None), ("A", None, "1", "1", "1", "1", "1", "M", "SN")],
                                ", ".join(f"{c} string" for c in weather.REPORT_COLUMNS))
    r = weather.observations(raw).first()
    assert (r.temp_c, r.dewp_c, r.vis_mi, r.wind_kt, r.precip_in, r.wx) == (3.5, None, 0.2, None, 0.001, "M")


def test_bins_and_bands(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert [r[0] for r in df.select(S.bin_by_edges("x", (0, 5, 10))).collect()] == [0, 1, 2, 3, 3]
    assert [r[0] for r in df.select(S.clip("x", 0, 6)).collect()] == [0.0, 0.0, 5.0, 6.0, 6.0]


def test_output_check_tells_null_from_nan(spark):
    template = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    good = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, 1.0)], "id long, y double")
    bad = spark.createDataFrame([(1, None), (1, math.nan), (4, -1.0), (2, 1.0)], "id long, y double")
    assert evaluate.check_output(good, template, "id", "y").count() == 0
    assert rows(evaluate.check_output(bad, template, "id", "y")) == [("duplicate", 1), ("extra", 1), ("invalid", 3), ("missing", 1)]
    assert rows(evaluate.check_output(good.withColumn("z", F.lit(1)), template, "id", "y")) == [("columns", 1)]


def test_template_default_and_rounding(spark):
    t = spark.createDataFrame([(1,), (2,)], "id long")
    p = spark.createDataFrame([(1, 10.5), (9, 3.0)], "id long, y double")
    assert rows(sinks.fill_template(t, p, "id", "y", 900)) == [(1, 11), (2, 900)]
    assert rows(sinks.fill_template(t, p, "id", "y", 900, as_int=False)) == [(1, 10.5), (2, 900.0)]


def test_composition_weights_sum_to_one(spark):
    scored = spark.createDataFrame([("A", 1)] * 99 + [("A", 2)] + [("B", 7)] * 100 + [("C", 1)] * 50, "site string, mon long")
    mix = evaluate.composition(scored, "site", "mon", 0.02)
    assert abs(mix.select("site", "weight").distinct().agg(F.sum("weight")).first()[0] - 1) < 1e-12
    assert rows(mix.where("NOT real"), "site", "mon") == [("A", 2)]


def test_work_list_and_manifest(spark):
    day = lambda *d: spark.createDataFrame([(x,) for x in d], "day string")
    done = spark.createDataFrame([("b", 2), ("c", 3)], "day string, version int")
    assert [r[0] for r in files.todo(day("a", "b", "c", "b"), done, 3, [F.col("day") != "b"]).collect()] == ["b", "a"]
    old = spark.createDataFrame([("k", "1"), ("gone", "2"), ("same", "3")], "key string, tag string")
    new = spark.createDataFrame([("k", "9"), ("new", "2"), ("same", "3")], "key string, tag string")
    assert rows(files.manifest_diff(old, new, "key", "tag"), "key", "change") == [("gone", "removed"), ("k", "modified"), ("new", "added")]


def test_reoccupied_looks_inside_the_open_interval(spark):
    spans = spark.createDataFrame([(1, "s", 0, 10_000_000), (2, "s", 5_000_000, 8_000_000), (3, "s", 8_000_000, 9_000_000)], "id long, k string, a long, b long")
    marks = spark.createDataFrame([("s", 0), ("s", 8_000_000)], "k string, t long")
    assert rows(setops.reoccupied(spans, marks, "k", "id", "a", "b", "t")) == [(1, True, 2.0), (2, False, None), (3, False, None)]


def test_empty_day_leaves_no_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "d1"), (2, "d2")], "x long, day string")
    path = sinks.write_if_any(df, str(tmp_path / "days"), "day")
    sinks.write_if_any(df.where("day = 'd3'"), path, "day")
    sinks.write_if_any(df.where("day = 'd1'").withColumn("x", F.lit(7).cast("long")), path, "day")
    assert rows(spark.read.parquet(path), "x", "day") == [(2, "d2"), (7, "d1")]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 9.0), ("c", 5.0, 5.0)],
                               "g string, x double, y double")
    assert rows(df.groupBy("g").agg(F.round(S.pearson("x", "y"), 9).alias("r"))) == [("a", None), ("b", 1.0), ("c", None)]


def test_documents_to_segments_to_departures(spark, tmp_path):
    """A missing altitude is in the air; lower-case and padded callsigns match."""
    point = lambda dt, alt, gs: f'[{dt},50.0,8.0,{alt},{gs},90,0,null,{{"flight":" abc12 "}}]'
    ground = '"ground"'
    trace = ",".join([point(0, ground, 0), point(60, ground, 5), point(70, "null", 120), "[1,2]"])
    (tmp_path / "a.json").write_text(f'{{"icao":"h1","t":"A320","timestamp":86400,"trace":[{trace}]}}')
    (tmp_path / "b.json").write_text("{")
    seg = traces.segments_of_documents(scan_traces(spark, str(tmp_path)), {"X": (50.0, 8.0)})
    got = seg.first()
    assert seg.count() == 1 and (got["site"], got["hex"], got["actype"], got["n_ground"], got["t_first_air"]) == ("X", "h1", "A320", 2, 86_470.0)
    raw = spark.sql("""SELECT 1L AS MVT_ID_mvt, 'DEP' AS PHASE_mvt, 'X' AS ADEP_mvt, ' abc12' AS CALLSIGN_flt, '' AS FLIGHT_mvt, 'S1' AS STAND_mvt,
        timestamp_seconds(86480) AS MVT_TIME_UTC_mvt, timestamp_seconds(86000) AS AOBT_3_flt, timestamp_seconds(86000) AS BLOCK_TIME_UTC_mvt,
        timestamp_seconds(85900) AS SCHED_TIME_UTC_mvt, 480 AS TAXITIME_SEC_mvt""")
    dep = traces.departures_to_match(raw)
    assert dep.first()["flt"] is None and dep.first()["day"] == 1
    assert [r["kind"] for r in traces.match_traces(dep, seg).collect()] == [1]
    assert traces.match_traces(dep.withColumn("cs", F.lit("abc12 ")), seg).count() == 1


def test_documents_are_read_once(spark):
    """However many steps need the points, what reads the documents runs once over each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    ground = '"ground"'
    body = lambda i: '{"icao":"h%d","timestamp":0,"trace":[%s]}' % (i, ",".join(f'[{t},50.0,8.0,{ground},{t},90,0,null,{{"flight":"A{i}"}}]' for t in (0, 60, 120)))
    texts = spark.createDataFrame([(str(i), body(i)) for i in range(7)], "path string, body string").mapInPandas(counted, "path string, body string")
    seg = traces.segments_of_documents(texts.select("path", F.try_parse_json("body").alias("doc")), {"X": (50.0, 8.0)})
    assert rows(seg, "entity", "hex", "callsign", "n_ground") == [(str(i), f"h{i}", f"A{i}", 3) for i in range(7)]
    assert seen.value == 7
