"""JN6-8, AG10-11, AG16, WN10, WN12-16 and the trace jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampwise.bindings.columns import _documents
from rampwise.bindings.registry import SQL, big, bind, ev, pt, six, table
from rampwise.functions import scalars as S
from rampwise.operators import groups, match, segments, sites
from rampwise.plans import traces
from rampwise.session import scratch_path
from rampwise.sources.archives import scan_archives, write_archives

# Purchases are matched to views: three keys, then a prefix with a close time.
SQL["km_l"] = """
    SELECT id, usr AS key1, usr % 50 AS key2, k AS key3, usr // 4 AS prefix, k % 2 AS site, t / 1000000 AS t
    FROM ev WHERE kind = 'purchase'"""
SQL["km_r"] = """
    SELECT id AS rid, usr AS rkey, usr // 4 AS prefix, k % 2 AS site,
           CASE WHEN id % 5 <> 0 THEN t / 1000000 END AS air, t / 1000000 - 60 AS last
    FROM ev WHERE kind = 'view'"""
# A purchase stands once for each of its keys; what is found is reduced to its lowest kind.
TOL, AFTER, NEAR = 36_000, 72_000, 10_800
SQL["km_keys"] = """
    SELECT id, site, t, unnest([{'kind': 1, 'rkey': key1}, {'kind': 2, 'rkey': key2}, {'kind': 3, 'rkey': key3}], recursive := true) FROM km_l"""
SQL["pairs"] = f"""
    SELECT id, rid, min(kind) AS kind, any_value(CASE WHEN air IS NULL THEN t - last + 60 ELSE abs(air - t) END) AS dist
    FROM km_keys JOIN km_r USING (site, rkey)
    WHERE CASE WHEN air IS NULL THEN t - last BETWEEN 0 AND {AFTER} ELSE air BETWEEN t - {TOL} AND t + {TOL} END GROUP BY id, rid"""
SQL["near"] = f"""
    SELECT id, rid, 4 AS kind, abs(air - t) AS dist FROM km_l JOIN km_r USING (site, prefix) WHERE air BETWEEN t - {NEAR} AND t + {NEAR}"""
SQL["cands"] = """
    SELECT id, rid, min(kind) AS kind, min(dist) AS dist FROM (FROM pairs UNION ALL FROM near) GROUP BY id, rid"""


def _sides(spark, d):
    e = ev(spark, d)
    secs = F.col("t") / 1_000_000
    left = e.where("kind = 'purchase'").select(
        "id", F.col("usr").alias("key1"), (F.col("usr") % 50).alias("key2"), F.col("k").alias("key3"),
        F.floor(F.col("usr") / 4).alias("prefix"), (F.col("k") % 2).alias("site"), secs.alias("t"))
    right = e.where("kind = 'view'").select(
        F.col("id").alias("rid"), F.col("usr").alias("rkey"), F.floor(F.col("usr") / 4).alias("prefix"), (F.col("k") % 2).alias("site"),
        F.when(F.col("id") % 5 != 0, secs).alias("air"), (secs - 60).alias("last"))
    return left, right


def _exact(spark, d):
    left, right = _sides(spark, d)
    pairs = match.match_any_key(left, right.drop("prefix"), [("key1", 1), ("key2", 2), ("key3", 3)], "rkey", ["site"],
                                "t", F.coalesce("air", "last"), AFTER)
    return match.within_reach(pairs, "t", "air", "last", TOL, AFTER).select("id", "rid", "kind", "dist")


def _near(spark, d):
    left, right = _sides(spark, d)
    return match.match_bucketed(left, right, ["site", "prefix"], "t", "air", NEAR, 14_400).select("id", "rid", "kind", "dist")


def _shape(df):
    return df.select("id", "rid", "kind", six("dist", "dist", 3))


@bind("jn6_match_any_key", uses="ev km_l km_r km_keys", sql=f"""
    SELECT id, rid, CAST(min(kind) AS BIGINT) AS kind FROM km_keys JOIN km_r USING (site, rkey)
    WHERE coalesce(air, last) BETWEEN t - {AFTER} AND t + {AFTER} GROUP BY id, rid""")
def jn6(spark, d):
    left, right = _sides(spark, d)
    return match.match_any_key(left, right.drop("prefix"), [("key1", 1), ("key2", 2), ("key3", 3)], "rkey", ["site"],
                               "t", F.coalesce("air", "last"), AFTER).select("id", "rid", "kind")


@bind("jn7_within_reach", uses="ev km_l km_r km_keys pairs", sql="""
    SELECT id, rid, CAST(kind AS BIGINT) AS kind, round(dist, 3) AS dist FROM pairs""")
def jn7(spark, d):
    return _shape(_exact(spark, d))


@bind("jn8_match_bucketed", uses="ev km_l km_r near", sql="""
    SELECT id, rid, CAST(kind AS BIGINT) AS kind, round(dist, 3) AS dist FROM near""")
def jn8(spark, d):
    return _shape(_near(spark, d))


@bind("ag11_collapse", uses="ev km_l km_r km_keys pairs near cands", sql="""
    SELECT id, rid, CAST(kind AS BIGINT) AS kind, round(dist, 3) AS dist FROM cands""")
def ag11(spark, d):
    return _shape(match.collapse(_exact(spark, d).unionByName(_near(spark, d)).withColumn("side", F.lit("x")), "id", "rid"))


@bind("wn10_accept", uses="ev km_l km_r km_keys pairs near cands", sql="""
    SELECT id, best.rid AS rid, CAST(best.kind AS BIGINT) AS kind, round(best.dist, 3) AS dist FROM (
        SELECT id, min({'kind': kind, 'dist': dist, 'rid': rid}) AS best, count(*) AS n FROM cands GROUP BY id)
    WHERE best.kind < 4 OR n = 1""")
def wn10(spark, d):
    exact, near = _exact(spark, d), _near(spark, d)
    from rampwise.operators.setops import without
    both = exact.unionByName(without(near, exact, ["id", "rid"]))
    return _shape(match.accept(both, "id", "rid"))


@bind("ag10_code_map", sql="""
    WITH tally AS (SELECT substr(p_name, 1, 2) AS ia, regexp_extract(p_brand, '#([1-9])[0-9]', 1) AS ic, count(*) AS n FROM part GROUP BY ALL),
         top AS (SELECT ia, max(n) AS n FROM tally WHERE ia <> '' GROUP BY ia)
    SELECT ia, min(ic) AS ic FROM tally JOIN top USING (ia, n) GROUP BY ia HAVING min(ic) <> ''""")
def ag10(spark, d):
    p = table(spark, d, "part").select(F.substring("p_name", 1, 2).alias("ia"), S.key_part("p_brand", "#([1-9])[0-9]").alias("ic"))
    return groups.learn_code_map(p, "ia", "ic")


# --- runs of points -------------------------------------------------------------------------
GAP, WITHIN = 6 * 3600, 6 * 3600
SQL["stepped"] = """
    SELECT *, lag(t) OVER w AS pt, lag(ground) OVER w AS pg, lag(site) OVER w AS ps, lag(gs) OVER w AS pgs,
           lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(t) OVER w AS nt, lead(ground) OVER w AS ng
    FROM pt WINDOW w AS (PARTITION BY usr ORDER BY t, seq)"""
SQL["flagged"] = f"""
    SELECT *, ground AND NOT coalesce(pg AND ps = site AND t - pt <= {GAP}000000, false) AS opens FROM stepped"""
SQL["runs"] = """
    SELECT * FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY usr ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS seg
                   FROM flagged) WHERE ground"""
SQL["summ"] = f"""
    SELECT usr, seg, count(*) AS n, min(t) AS t0, min(CASE WHEN gs >= 3 THEN t END) AS tm, max(t) AS t1,
           arg_min(gs, t) AS gs0, arg_min(lat, t) AS lat0, arg_max(lon, t) AS lon1, arg_max(nt, t) AS nt, arg_max(ng, t) AS ng,
           arg_min(site, t) AS site
    FROM runs GROUP BY 1, 2 HAVING count(*) >= 2"""
SQL["lifted"] = f"""
    SELECT *, CASE WHEN NOT ng AND nt - t1 <= {WITHIN}000000 THEN nt END AS ta FROM summ"""
SQL["moved"] = """
    SELECT usr, seg, sum(CASE WHEN step THEN sqrt(pow((lat - plat) * 111320.0, 2)
                              + pow((lon - plon) * 111320.0 * cos(radians(lat)), 2)) ELSE 0 END) AS path_m,
           sum(CASE WHEN step AND gs < 1 AND pgs < 1 THEN dt ELSE 0 END) AS stopped_s,
           count(*) FILTER (WHERE coalesce(t >= tm, false) AND NOT opens AND gs < 1 AND pgs >= 3) AS n_stops,
           max(CASE WHEN t >= tm THEN gs ELSE 0 END) AS max_gs
    FROM (SELECT *, (t - pt) / 1000000 AS dt, coalesce(t >= tm, false) AND NOT opens AND (t - pt) BETWEEN 1 AND 14400000000 AS step
          FROM (SELECT *, min(CASE WHEN gs >= 3 THEN t END) OVER (PARTITION BY usr, seg) AS tm FROM runs))
    GROUP BY 1, 2"""
SQL["named"] = """
    SELECT usr, seg, arg_max(callsign, (n, -first)) AS callsign FROM (
        SELECT usr, seg, callsign, sum(n) AS n, min(first) AS first FROM (
            SELECT usr, seg, callsign, count(*) AS n, min(t) AS first FROM runs WHERE callsign IS NOT NULL GROUP BY 1, 2, 3
            UNION ALL
            SELECT l.usr, l.seg, arg_min(p.callsign, p.t), 1, 9000000000000000000 FROM lifted l
            JOIN pt p ON p.usr = l.usr AND p.t > l.t1 AND p.callsign IS NOT NULL WHERE l.ta IS NULL GROUP BY 1, 2)
        GROUP BY 1, 2, 3) GROUP BY 1, 2"""
RUNS = "ev pt stepped flagged runs"


def _points(spark, d):
    return pt(spark, d).withColumnRenamed("usr", "entity").withColumn("t", F.col("t") / 1_000_000)


def _us(c, name):
    return F.round(F.col(c) * 1_000_000).cast("long").alias(name)


@bind("wn12_segments", uses=RUNS, sql="SELECT usr AS entity, seq, CAST(seg AS BIGINT) AS seg, NOT opens AS inside FROM runs")
def wn12(spark, d):
    return segments.segments(_points(spark, d), max_gap=GAP).select("entity", "seq", "seg", "inside")


@bind("wn13_summarise", uses=RUNS + " summ", sql="""
    SELECT usr AS entity, CAST(seg AS BIGINT) AS seg, CAST(n AS BIGINT) AS n_ground, t0, tm, t1, round(gs0, 6) AS gs_first,
           lat0, round(lon1, 9) AS lon_last FROM summ""")
def wn13(spark, d):
    s = segments.summarise(segments.segments(_points(spark, d), max_gap=GAP))
    return s.select("entity", "seg", "n_ground", _us("t_first_ground", "t0"), _us("t_first_moving", "tm"),
                    _us("t_last_ground", "t1"), six("gs_first", "gs_first"), "lat0", six("lon_last", "lon_last", 9))


@bind("wn14_next_after", uses=RUNS + " summ lifted", sql="SELECT usr AS entity, CAST(seg AS BIGINT) AS seg, ta FROM lifted")
def wn14(spark, d):
    s = segments.next_after(segments.summarise(segments.segments(_points(spark, d), max_gap=GAP)), WITHIN)
    return s.select("entity", "seg", _us("t_first_air", "ta"))


@bind("wn15_later_name", uses="ev pt", sql="""
    SELECT usr AS entity, seq, first_value(callsign IGNORE NULLS) OVER (
        PARTITION BY usr ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM pt""")
def wn15(spark, d):
    p = _points(spark, d)
    return segments.later_name(p.select("entity", "t", "seq"), p).select("entity", "seq", "later")


@bind("wn16_motion", uses=RUNS + " moved", sql="""
    SELECT usr AS entity, CAST(seg AS BIGINT) AS seg, round(path_m, 3) AS path_m, round(stopped_s, 3) AS stopped_s,
           CAST(n_stops AS BIGINT) AS n_stops, round(max_gs, 6) AS max_gs FROM moved""")
def wn16(spark, d):
    m = segments.motion(segments.segments(_points(spark, d), max_gap=GAP), max_step=14_400)
    return m.select("entity", "seg", six("path_m", "path_m", 3), six("stopped_s", "stopped_s", 3), "n_stops", six("max_gs", "max_gs"))


@bind("ag16_run_names", uses=RUNS + " summ lifted named", sql="""
    SELECT usr AS entity, CAST(seg AS BIGINT) AS seg, callsign FROM named""")
def ag16(spark, d):
    p = _points(spark, d)
    runs = segments.segments(p, max_gap=GAP)
    lifted = segments.next_after(segments.summarise(runs, min_points=1), WITHIN)
    # The tally of a lone point counts too, but the next name is only added to real runs.
    real = lifted.where("n_ground >= 2")
    return segments.run_names(runs, real, p)


FB7 = """
    SELECT l.usr AS entity, CAST(l.seg AS BIGINT) AS seg, l.site, CAST(l.n AS BIGINT) AS n_ground, l.t0, l.tm, l.t1, l.ta,
           n.callsign, round(m.stopped_s, 3) AS stopped_s, round(m.path_m, 3) AS path_m
    FROM lifted l LEFT JOIN named n USING (usr, seg)
    LEFT JOIN (SELECT usr, seg, sum(CASE WHEN step AND gs < 1 AND pgs < 1 THEN dt ELSE 0 END) AS stopped_s,
                      sum(CASE WHEN step THEN sqrt(pow((lat - plat) * 111320.0, 2)
                          + pow((lon - plon) * 111320.0 * cos(radians(lat)), 2)) ELSE 0 END) AS path_m
               FROM (SELECT *, (t - pt) / 1000000 AS dt, coalesce(t >= tm, false) AND NOT opens AND (t - pt) BETWEEN 1 AND 300000000 AS step
                     FROM (SELECT *, min(CASE WHEN gs >= 3 THEN t END) OVER (PARTITION BY usr, seg) AS tm FROM runs))
               GROUP BY 1, 2) m USING (usr, seg)"""


def _segments_out(out):
    return out.select("entity", "seg", "site", "n_ground", _us("t_first_ground", "t0"), _us("t_first_moving", "tm"),
                      _us("t_last_ground", "t1"), _us("t_first_air", "ta"), "callsign", six("stopped_s", "stopped_s", 3),
                      six("path_m", "path_m", 3))


@bind("fb7_ground_segments", uses=RUNS + " summ lifted moved named", sql=FB7)
def fb7(spark, d):
    return _segments_out(traces.ground_segments(_points(spark, d), max_gap=GAP, within=WITHIN))


@bind("fb7_archive_segments", uses=RUNS + " summ lifted moved named", sql=FB7)
def fb7_archives(spark, d):
    """The same from documents: written to archives, read by ranges, sites found by their boxes."""
    docs = _documents(spark, d, daily=False, damaged=False)
    path = write_archives(docs, scratch_path(spark, "archives"), "usr")
    places = sites.site_table(spark, {f"S{i}": (0.012 + 0.025 * i, 0.0) for i in range(4)})
    out = traces.segments_of_documents(scan_archives(spark, path), places, max_gap=GAP, within=WITHIN, box=(0.0122, 360.0))
    return _segments_out(out.withColumn("entity", F.substring("hex", 2, 20).cast("long")))
