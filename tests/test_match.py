"""Candidate joins against brute force, the acceptance rule, and run segmentation on small traces."""

import gzip
import json

from pyspark.sql import functions as F

from rampwise.bindings.registry import ev
from rampwise.operators import groups, match, segments
from rampwise.plans import traces as plans
from rampwise.sources import traces
from tests.conftest import rows


def test_any_key_equals_or_join(spark, data):
    e = ev(spark, data)
    secs = (F.col("t") / 1_000_000).alias("t")
    left = e.where("kind = 'purchase'").select("id", "key", F.col("usr").alias("a"), (F.col("k") % 15).alias("b"), secs)
    right = e.where("kind = 'view'").select(F.col("id").alias("rid"), "key", F.col("usr").alias("r"), secs.alias("at"))
    got = match.match_any_key(left, right, [("a", 1), ("b", 2)], "r", ["key"], "t", F.col("at"), 50_000)
    held_l, held_r = left.collect(), right.collect()
    want = sorted(((x.id, y.rid, 1 if x.a == y.r else 2) for x in held_l for y in held_r
                   if x.key == y.key and y.r in (x.a, x.b) and abs(x.t - y["at"]) <= 50_000))
    assert want and rows(got, "id", "rid", "kind") == want
    near = match.match_bucketed(left, right, ["key"], "t", "at", 900, 1000)
    assert rows(near, "id", "rid") == sorted(((x.id, y.rid) for x in held_l for y in held_r
                                              if x.key == y.key and abs(x.t - y["at"]) <= 900))


def test_reach_of_pairs_with_and_without_lift_off(spark):
    pairs = spark.createDataFrame([(1, 1000.0, 1180.0, 0.0), (2, 1000.0, 1181.0, 0.0), (3, 1000.0, None, 640.0), (4, 1000.0, None, 639.0),
                                   (5, 1000.0, None, 1001.0)], "id long, t double, air double, last double")
    assert rows(match.within_reach(pairs, "t", "air", "last"), "id", "dist") == [(1, 180.0), (3, 420.0)]


def test_ambiguous_weak_candidates_are_rejected(spark):
    c = spark.createDataFrame([(1, 10, 4, 5.0), (2, 11, 4, 5.0), (2, 12, 4, 1.0), (3, 13, 4, 0.0), (3, 14, 4, 0.0), (3, 15, 2, 9.0),
                               (4, 17, 1, 3.0), (4, 16, 1, 3.0)], "id long, rid long, kind long, dist double")
    assert rows(match.accept(c, "id", "rid"), "id", "rid") == [(1, 10), (3, 15), (4, 16)]


def test_code_map_drops_a_source_whose_commonest_target_is_empty(spark):
    df = spark.createDataFrame([("A", "")] * 3 + [("A", "X")] * 2 + [("B", "Y"), ("B", "Z")] + [("", "W")], "s string, t string")
    assert rows(groups.learn_code_map(df, "s", "t")) == [("B", "Y")]


def _points(spark, data):
    return spark.createDataFrame(
        [("h", float(t), i, g, s, 0.0, 0.0, gs, c) for i, (t, g, s, gs, c) in enumerate(data)],
        "entity string, t double, seq long, ground boolean, site string, lat double, lon double, gs double, callsign string")


def test_runs_end_at_gaps_sites_and_air(spark):
    p = _points(spark, [(0, True, "A", 0.0, "X"), (1800, True, "A", 5.0, "Y"), (3601, True, "A", 0.0, None), (3602, True, "B", 0.0, None),
                        (3603, True, "B", 9.0, None), (3604, False, "B", 99.0, "Z"), (3605, True, "B", 1.0, None), (3606, True, None, 1.0, None),
                        (3607, True, "B", 1.0, None)])
    runs = segments.segments(p)
    assert [r[1] for r in rows(runs, "seq", "seg")] == [1, 1, 2, 3, 3, 4, 5]
    s = segments.next_after(segments.summarise(runs))
    got = rows(s, "seg", "n_ground", "t_first_moving", "t_first_air")
    # The first run is ended by a ground point, so it has no lift-off; a run of one point is dropped.
    assert got == [(1, 2, 1800.0, None), (3, 2, 3603.0, 3604.0)]
    # Without a lift-off the next name heard (Z) joins the tally; of X, Y, Z with one each the first seen wins.
    assert rows(segments.run_names(runs, s, p).where("seg IN (1, 3)"), "seg", "callsign") == [(1, "X")]


def test_motion_counts_from_the_first_moving_point(spark):
    data = [(0, True, "A", 0.0, None), (100, True, "A", 4.0, None), (200, True, "A", 0.5, None), (300, True, "A", 0.5, None),
            (700, True, "A", 0.2, None), (800, True, "A", 6.0, None), (900, True, "A", None, None)]
    p = _points(spark, data).withColumn("lat", F.col("t") / 100_000)
    m = segments.motion(segments.segments(p)).first()
    # The step of 400 s is left out of path and stopped time.
    assert round(m["path_m"], 3) == round(111_320 * 500 / 100_000, 3)
    assert (m["stopped_s"], m["n_stops"], m["max_gs"]) == (100.0, 2, 6.0)


def test_trace_documents(spark, tmp_path):
    def entry(dt, alt, gs, flight=None):
        return [dt, 50.0, 8.0, alt, gs, 90.0, 1, None, {"flight": flight} if flight else None]

    doc = {"icao": "abc", "t": "A320", "r": "D-X", "timestamp": 1000, "trace": [
        entry(0, "ground", 0, "DLH1 "), entry(10, "ground", 5), [1, 2, 3], [20, None, 8.0, "ground", 1, 1, 0, None, None], entry(60, 2500, 150)]}
    (tmp_path / "a.json").write_bytes(gzip.compress(json.dumps(doc).encode()))
    (tmp_path / "b.json").write_text(json.dumps({"icao": "def", "trace": []}))
    (tmp_path / "c.json").write_bytes(gzip.compress(json.dumps(doc).encode())[:40])
    (tmp_path / "d.json").write_text("{not json")
    docs = traces.scan_traces(spark, str(tmp_path))
    assert docs.where("doc IS NULL").count() == 2 and docs.where("error IS NULL").count() == 2
    points = traces.explode_points(docs)
    assert rows(points, "seq", "t", "ground", "gs", "callsign", "stale") == [
        (0, 1000.0, True, 0.0, "DLH1", True), (1, 1010.0, True, 5.0, None, True), (4, 1060.0, False, 150.0, None, True)]
    seg = plans.ground_segments(points.withColumn("entity", F.col("hex")), {"S": (50.0, 8.0)}).first()
    assert (seg["site"], seg["callsign"], seg["t_first_moving"], seg["t_first_air"], seg["stale_first"]) == ("S", "DLH1", 1010.0, 1060.0, True)


def test_reach_below_the_width_loses_no_pair(spark):
    """Every difference up to the reach, also across slots and below zero; copies only where the reach goes."""
    left = spark.createDataFrame([(i, "k", float(t)) for i, t in enumerate(range(-700, 700, 50))], "id long, key string, t double")
    right = spark.createDataFrame([(i, "k", float(t)) for i, t in enumerate(range(-650, 650, 37))] + [(99, "k", None)], "rid long, rkey string, at double")
    got = match.match_any_key(left, right, [("key", 1)], "rkey", [], "t", F.col("at"), 600, 360)
    want = sorted((x.id, y.rid) for x in left.collect() for y in right.collect() if y.at is not None and abs(x.t - y.at) <= 360)
    assert rows(got, "id", "rid") == want
    spread = match._spread(right.where("at IS NOT NULL"), F.col("at"), 600, 90, "slot")
    assert spread.count() < 1.6 * right.count()


def test_written_trace_documents_come_back(spark, tmp_path):
    """A file for each document in a bounded number of folders, without a column's folder for each."""
    bodies = {f"n {i}/ü%": json.dumps({"icao": str(i), "trace": []}) for i in range(600)} | {"none": None, "cut": '{"icao":'}
    held = spark.createDataFrame(list(bodies.items()) + [(None, "{}")], "usr string, body string")
    path = traces.write_traces(held, f"file:{tmp_path}/made", "usr")
    traces.write_traces(held, path, "usr")  # a job that runs again replaces its own files
    docs = traces.scan_traces(spark, path, "*")
    assert docs.groupBy("error").count().orderBy("error").collect() == [(None, 601), ("malformed", 2)]
    assert docs.agg(F.countDistinct(F.try_variant_get("doc", "$.icao", "string"))).first()[0] == 600
    assert len(list((tmp_path / "made").iterdir())) <= traces.FOLDERS
    empty = traces.write_traces(held.where("false"), f"{tmp_path}/empty", "usr")
    assert traces.scan_traces(spark, empty, "*").count() == 0
