"""SRC, SNK, PRJ and the plain joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampwise.bindings.registry import big, bind, ev, gr, mx, pt, six, table, wx
from rampwise.functions import scalars as S
from rampwise.operators import groups, setops, sites
from rampwise.plans import departures
from rampwise.sources import archives, files, published, sinks, traces
from rampwise.session import scratch_path


# --- sources ---------------------------------------------------------------------------

@bind("src1_scan", sql="SELECT event_id, user_id, event_type, value FROM events")
def src1(spark, d):
    return files.scan(spark, f"{d}/event[s].parquet").select("event_id", "user_id", "event_type", "value")


@bind("src2_split_by_month", sql="""
    SELECT CASE WHEN month(l_shipdate) IN (1, 7) THEN 'val' ELSE 'fit' END AS part,
           CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice / 6.1803398875), 4) AS price
    FROM lineitem GROUP BY 1""")
def src2(spark, d):
    months = table(spark, d, "lineitem").select("l_extendedprice", F.month("l_shipdate").alias("month"))
    path = sinks.write(months, scratch_path(spark, "by-month"), by="month")
    fit, val = files.split_files(files.scan(spark, path), "month", [1, 7])
    both = fit.withColumn("part", F.lit("fit")).unionByName(val.withColumn("part", F.lit("val")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), six(F.avg(F.col("l_extendedprice") / 6.1803398875), "price", 4))


@bind("src3_mixed_scan", sql="""
    SELECT o_custkey, o_orderkey FROM orders UNION ALL SELECT o_custkey, o_orderkey FROM orders
    WHERE o_orderstatus = 'P'""")
def src3(spark, d):
    extra = scratch_path(spark, "extra")
    sinks.write(files.scan(spark, f"{d}/orders.parquet").where("o_orderstatus = 'P'"), extra)
    return files.scan(spark, [f"{d}/order[s].parquet", extra]).select("o_custkey", "o_orderkey")


@bind("src4_evolving_scan", sql="""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal,
           CAST(NULL AS DOUBLE) AS path_m, CAST(NULL AS VARCHAR) AS reg FROM customer""")
def src4(spark, d):
    c = table(spark, d, "customer")
    path = scratch_path(spark, "evolving")
    c.where("c_custkey % 2 = 1").select("c_custkey").write.parquet(f"{path}/version=1")
    c.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal").write.parquet(f"{path}/version=2")
    return files.scan_evolving(spark, path, {"c_acctbal": "double", "path_m": "double", "reg": "string"}).drop("version")


@bind("src5_lenient_csv", uses="ev wx", sql="""
    SELECT station, code, CASE WHEN p01i = 'T' THEN 0.001 ELSE TRY_CAST(p01i AS DOUBLE) END AS precip
    FROM (SELECT CAST(key AS VARCHAR) AS station, code, CASE WHEN wind % 9 = 0 THEN 'T'
                 WHEN precip IS NULL THEN 'M' ELSE CAST(CAST(precip AS BIGINT) AS VARCHAR) END AS p01i
          FROM wx WHERE wind % 10 <> 7)""")
def src5(spark, d):
    p01i = (F.when(F.col("wind") % 9 == 0, "T").when(F.col("precip").isNull(), "M")
            .otherwise(F.col("precip").cast("long").cast("string")))
    # Every tenth line has a field too many, as damaged reports do.
    line = F.concat_ws(",", F.col("key").cast("string"), "code", p01i,
                       F.when(F.col("wind") % 10 == 7, "surplus"))
    path = scratch_path(spark, "weather")
    wx(spark, d).select(line.alias("value")).write.text(path)
    rows = files.scan_csv_lenient(spark, path, ["station", "code", "p01i"], header=False)
    return rows.select("station", "code", S.parse_sentinel("p01i", {"T": 0.001}).alias("precip"))


def _documents(spark, d, daily: bool = True, damaged: bool = True):
    """One document per user and day, in the shape of a trace file."""
    p = pt(spark, d)
    day = 86_400_000_000
    p = p.withColumn("base", ((F.col("t") - F.pmod("t", F.lit(day))) / 1_000_000) if daily else F.lit(0.0))
    entry = F.concat(
        F.lit("["), F.concat_ws(
            ",", (F.col("t") / 1_000_000 - F.col("base")).cast("decimal(20,6)").cast("string"),
            F.when(F.lit(damaged) & (F.col("seq") % 50 == 0), "null").otherwise(F.col("lat").cast("string")), F.col("lon").cast("string"),
            F.when(F.col("ground"), '"ground"').otherwise("3500"), F.col("gs").cast("string"), F.lit("90"),
            (F.col("seq") % 4).cast("string"), F.lit("null"),
            F.when(F.col("callsign").isNull(), "null")
            .otherwise(F.concat(F.lit('{"flight":" '), F.col("callsign"), F.lit(' "}')))), F.lit("]"))
    # A third of the odd entries is cut short.
    entry = F.when(F.lit(damaged) & (F.col("seq") % 37 == 0), F.lit("[1,2,3]")).otherwise(entry)
    grouped = p.groupBy("usr", "base").agg(F.sort_array(F.collect_list(F.struct("t", "seq", entry.alias("e")))).alias("x"))
    body = F.concat(F.lit('{"icao":"h'), F.col("usr").cast("string"), F.lit('","timestamp":'),
                    F.col("base").cast("long").cast("string"), F.lit(',"trace":['),
                    F.concat_ws(",", F.col("x.e")), F.lit("]}"))
    return grouped.select("usr", "base", body.alias("body"))


@bind("src6_scan_traces", uses="ev", sql="""
    SELECT CASE WHEN usr % 25 = 0 THEN 'malformed' END AS error, CAST(count(DISTINCT usr) AS BIGINT) AS files,
           CAST(count(DISTINCT CASE WHEN usr % 25 <> 0 THEN usr END) AS BIGINT) AS parsed,
           CAST(count(CASE WHEN usr % 25 <> 0 AND id % 50 <> 0 AND id % 37 <> 0 THEN 1 END) AS BIGINT) AS points FROM ev GROUP BY 1""")
def src6(spark, d):
    whole = _documents(spark, d, daily=False)
    cut = F.when(F.col("usr") % 25 == 0, F.substring("body", 1, 20)).otherwise(F.col("body"))
    path = traces.write_traces(whole.select("usr", cut.alias("body")), scratch_path(spark, "traces"), "usr")
    out = traces.scan_traces(spark, path, "*")
    points = traces.explode_points(out.where("doc IS NOT NULL")).agg(F.count(F.lit(1))).scalar()
    return out.groupBy("error").agg(F.count(F.lit(1)).alias("files"), F.count("doc").alias("parsed"),
                                    F.when(F.count("doc") > 0, points).otherwise(F.lit(0)).cast("long").alias("points"))


@bind("src6_scan_archives", uses="ev", sql="""
    SELECT CASE WHEN usr % 25 = 0 THEN 'malformed' END AS error, CAST(count(DISTINCT usr) AS BIGINT) AS files,
           CAST(count(DISTINCT CASE WHEN usr % 25 <> 0 THEN usr END) AS BIGINT) AS parsed,
           CAST(count(CASE WHEN usr % 25 <> 0 AND id % 50 <> 0 AND id % 37 <> 0 THEN 1 END) AS BIGINT) AS points FROM ev GROUP BY 1""")
def src6_archives(spark, d):
    whole = _documents(spark, d, daily=False)
    cut = F.when(F.col("usr") % 25 == 0, F.substring("body", 1, 20)).otherwise(F.col("body"))
    path = archives.write_archives(whole.select("usr", cut.alias("body")), scratch_path(spark, "archives"), "usr")
    out = archives.scan_archives(spark, path, 1 << 20)
    points = traces.explode_points(out.where("doc IS NOT NULL"), keep=("path",)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return out.join(points, "path", "left").groupBy("error").agg(
        F.count(F.lit(1)).alias("files"), F.count("doc").alias("parsed"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("points"))


@bind("src7_explode_points", uses="ev pt", sql="""
    SELECT 'h' || CAST(usr AS VARCHAR) AS hex, t AS t_us, lat, round(lon, 9) AS lon, ground, round(gs, 6) AS gs,
           seq % 2 = 1 AS stale, callsign
    FROM pt WHERE seq % 50 <> 0 AND seq % 37 <> 0""")
def src7(spark, d):
    docs = _documents(spark, d).select(F.try_parse_json("body").alias("doc"))
    return traces.explode_points(docs).select(
        "hex", F.round(F.col("t") * 1_000_000).cast("long").alias("t_us"), "lat", six("lon", "lon", 9), "ground",
        six("gs", "gs"), "stale", "callsign")


@bind("src8_audit_columns", sql="""
    SELECT 'o_orderpriority' AS "column", CAST(count(nullif(o_orderpriority, '5-LOW')) AS BIGINT) AS filled,
           CAST(count(*) AS BIGINT) AS total, round(count(nullif(o_orderpriority, '5-LOW')) / count(*), 6) AS share
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'o_orderdate', count(o_orderdate), count(*), 1.0 FROM orders WHERE o_orderstatus = 'F'""")
def src8(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    out = files.audit_columns(o, ["prior", "date"], F.col("o_orderstatus") == "F")
    return out.select("column", "filled", "total", six("share", "share"))


@bind("src10_days_of", sql="SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' ORDER BY 1")
def src10(spark, d):
    return files.days_of(table(spark, d, "events"), "ts", F.col("event_type") == "click")


@bind("src11_todo", sql="""
    SELECT DISTINCT CAST(ts AS DATE) AS day FROM events
    WHERE NOT (day(ts) % 2 = 0 AND day(ts) % 4 <> 0) ORDER BY 1""")
def src11(spark, d):
    wanted = files.days_of(table(spark, d, "events"), "ts")
    n = F.dayofmonth("day")
    done = wanted.where(n % 2 == 0).select("day", F.when(n % 4 == 0, 2).otherwise(3).alias("version"))
    return files.todo(wanted, done, 3, [F.col("day") > F.lit("2024-01-15").cast("date")])


@bind("src12_manifest_diff", sql="""
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'removed' WHEN p_partkey % 10 = 4 THEN 'added' ELSE 'modified' END
           AS change, CASE WHEN p_partkey % 10 <> 4 THEN p_brand END AS old_p_brand,
           CASE WHEN p_partkey % 10 = 4 THEN p_brand WHEN p_partkey % 10 = 5 THEN p_brand || 'x' END AS new_p_brand
    FROM part WHERE p_partkey % 10 IN (3, 4, 5)""")
def src12(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    digit = F.col("p_partkey") % 10
    new = p.where(digit != 3).withColumn("p_brand", F.when(digit == 5, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")))
    return files.manifest_diff(p.where(digit != 4), new, "p_partkey", "p_brand")


# --- sinks ---------------------------------------------------------------------------------

def _spend(spark, d):
    return (table(spark, d, "orders").where("o_orderstatus <> 'P'")
            .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.col("o_totalprice") / 6.1803398875).alias("spend")))


@bind("snk1_write", sql="""
    SELECT o_custkey AS c_custkey, round(avg(o_totalprice / 6.1803398875), 4) AS spend FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY 1""")
def snk1(spark, d):
    path = sinks.write(_spend(spark, d), scratch_path(spark, "spend"))
    return spark.read.parquet(path).select("c_custkey", six("spend", "spend", 4))


@bind("snk2_save_features", sql="SELECT c_custkey, c_acctbal FROM customer")
def snk2(spark, d):
    name = "rampwise_" + scratch_path(spark, "f").rsplit("-", 1)[1]
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    sinks.save_features(rows.where("c_custkey < 0"), name, "c_custkey", buckets=8)
    sinks.save_features(rows, name, "c_custkey", buckets=8)
    return spark.table(name)


@bind("snk3_write_if_any", sql="""
    SELECT CAST(day(ts) AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS n FROM events
    WHERE event_type = 'error' AND day(ts) % 3 <> 0 GROUP BY 1""")
def snk3(spark, d):
    e = table(spark, d, "events").select("event_id", F.dayofmonth("ts").alias("day"), "event_type")
    path = scratch_path(spark, "days")
    sinks.write_if_any(e.where("event_type = 'error' AND day % 3 = 1"), path, "day")
    sinks.write_if_any(e.where("event_type = 'error' AND day % 3 = 2"), path, "day")
    sinks.write_if_any(e.where("event_type = 'none'"), path, "day")
    return spark.read.parquet(path).groupBy(big("day", "day")).agg(F.count(F.lit(1)).alias("n"))


@bind("snk3_publish_days", sql="""
    SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events
    WHERE event_type = CASE WHEN day(ts) % 3 = 0 THEN 'click' ELSE 'error' END GROUP BY ALL""")
def snk3_published(spark, d):
    """Errors of all days are published, then clicks in place of every third day's; the first run once more changes nothing."""
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"))
    path = scratch_path(spark, "published")
    for kind, days, run in (("error", F.lit(True), "errors"), ("click", F.dayofmonth("day") % 3 == 0, "clicks"), ("error", F.lit(True), "errors")):
        published.publish_days(e.where((F.col("event_type") == kind) & days), path, "day", run)
    return published.read_published(spark, path).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@bind("src11_published_todo", sql="""
    SELECT DISTINCT CAST(ts AS DATE) AS day FROM events EXCEPT
    SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'purchase' AND day(ts) % 2 = 0""")
def src11_published(spark, d):
    """Even days are published in the current version, odd ones in an older one."""
    e = table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    path = scratch_path(spark, "published")
    for version in (3, 2):
        rest = F.dayofmonth("day") % 2 == 3 - version
        published.publish_days(e.where((F.col("event_type") == "purchase") & rest), path, "day", f"v{version}", version)
    done = published.published(spark, path).select(F.col("day").cast("date").alias("day"), "version")
    return files.todo(e.select("day"), done, 3)


@bind("snk4_fill_template", sql="""
    SELECT c_custkey, CAST(round(coalesce(spend, 900)) AS INTEGER) AS spend FROM customer
    LEFT JOIN (SELECT o_custkey, avg(o_totalprice / 6.1803398875) AS spend FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
      ON o_custkey = c_custkey""")
def snk4(spark, d):
    return sinks.fill_template(table(spark, d, "customer"), _spend(spark, d), "c_custkey", "spend", 900)


# --- projections -----------------------------------------------------------------------------

@bind("prj1_canonical", uses="ev mv", sql="""
    SELECT id, site, phase, fin * 1000000 AS fin_us, start * 1000000 AS start_us, ref IS NULL AS unmatched,
           CAST(y AS DOUBLE) AS y FROM mv""")
def prj1(spark, d):
    from rampwise.bindings.registry import movements
    out = departures.canonical(movements(spark, d))
    return out.select("id", "site", "phase", F.unix_micros("fin").alias("fin_us"), F.unix_micros("start").alias("start_us"),
                      "unmatched", "y")


@bind("prj2_labelled", sql="""
    SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linestatus = 'O'
      AND nullif(l_quantity, 7) IS NOT NULL AND l_quantity - 3 > 0""")
def prj2(spark, d):
    li = table(spark, d, "lineitem").withColumn("y", F.nullif("l_quantity", F.lit(7.0)) - 3)
    return files.labelled(li, "l_linestatus", "y", "O").select("l_orderkey", "l_quantity")


@bind("prj3_seconds_between", sql="""
    SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000 AS secs FROM events""")
def prj3(spark, d):
    e = table(spark, d, "events").withColumn("origin", F.lit("2024-01-01").cast("timestamp_ntz"))
    return e.select("event_id", S.seconds_between(e, "ts", "origin").alias("secs"))


@bind("prj4_first_known", uses="mx", sql="SELECT id, coalesce(d, CASE WHEN matched THEN y END, -1) AS ref FROM mx")
def prj4(spark, d):
    return mx(spark, d).select("id", S.first_known("d", F.when(F.col("matched"), F.col("y")), F.lit(-1.0)).alias("ref"))


@bind("prj5_calendar", sql="""
    SELECT event_id, CAST(extract(hour FROM ts) AS BIGINT) AS hr, CAST(extract(dow FROM ts) AS BIGINT) AS dow,
           CAST(extract(month FROM ts) AS BIGINT) AS mon, CAST(extract(year FROM ts) AS BIGINT) AS yr FROM events""")
def prj5(spark, d):
    return table(spark, d, "events").select("event_id", *S.calendar("ts"))


@bind("prj6_clip", sql="SELECT o_orderkey, greatest(60, least(90000, o_totalprice)) AS y FROM orders")
def prj6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.clip("o_totalprice", 60.0, 90000.0).alias("y"))


EDGES = (5, 10, 20, 40)
_BIN = ("CASE WHEN {0} < 5 THEN 0 WHEN {0} < 10 THEN 1 WHEN {0} < 20 THEN 2 WHEN {0} < 40 THEN 3 ELSE 4 END")


@bind("prj7_bin_by_edges", uses="mx", sql=f"SELECT id, d, CAST({_BIN.format('d')} AS BIGINT) AS band FROM mx")
def prj7(spark, d):
    return mx(spark, d).select("id", "d", S.bin_by_edges("d", EDGES).alias("band"))


@bind("prj8_labelled_band", uses="mx", sql="""
    SELECT id, CASE WHEN abs(y - d) = 0 THEN 'exact' WHEN abs(y - d) <= 1 THEN 'near' WHEN abs(y - d) <= 10 THEN 'off'
                    ELSE 'far' END AS band FROM mx""")
def prj8(spark, d):
    return mx(spark, d).select("id", S.labelled_band(F.col("y") - F.col("d"), [(0, "exact"), (1, "near"), (10, "off")], "far").alias("band"))


@bind("prj9_parse_sentinel", uses="ev wx", sql="""
    SELECT id, CASE WHEN wind % 9 = 0 THEN 0.001 WHEN precip IS NULL THEN NULL ELSE precip END AS precip FROM wx""")
def prj9(spark, d):
    text = F.when(F.col("wind") % 9 == 0, "T").when(F.col("precip").isNull(), "M").otherwise(F.col("precip").cast("string"))
    return wx(spark, d).select("id", S.parse_sentinel(text, {"T": 0.001, "M": None}).alias("precip"))


@bind("prj10_parse_instant", sql="""
    SELECT event_id, epoch_us(date_trunc('minute', ts)) AS t_us FROM events""")
def prj10(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("text"))
    return e.select("event_id", F.unix_micros(S.parse_instant("text", "yyyy-MM-dd HH:mm")).alias("t_us"))


@bind("prj11_coded_flags", uses="ev wx", sql="""
    SELECT id, CAST(c LIKE '%SI%' OR c LIKE '%PU%' AS BIGINT) AS coded, CAST(precip < 5 AS BIGINT) AS low
    FROM (SELECT id, precip, nullif(code, 'VIEW') AS c FROM wx)""")
def prj11(spark, d):
    return wx(spark, d).select("id", S.flag(S.coded_flag(F.nullif("code", F.lit("VIEW")), ["SI", "PU"])).alias("coded"),
                               S.flag(F.col("precip") < 5).alias("low"))


@bind("prj12_null_if_stale", uses="ev wx", sql="""
    SELECT id, CASE WHEN wind <= 60 THEN precip END AS precip, CASE WHEN wind <= 60 THEN code END AS code FROM wx""")
def prj12(spark, d):
    w = wx(spark, d)
    return S.null_if_stale(w, F.col("wind"), 60, ["precip", "code"]).select("id", "precip", "code")


@bind("prj13_minutes_crossed", uses="ev", sql="""
    SELECT id, CAST(date_diff('minute', make_timestamp(t - k * 7777777), make_timestamp(t)) AS BIGINT) AS mins,
           least(CASE WHEN k > 50 THEN date_diff('minute', make_timestamp(t - k * 7777777), make_timestamp(t)) / 60.0 END, 0.15)
               AS hours FROM ev""")
def prj13(spark, d):
    mins = S.minutes_crossed(F.col("t"), F.col("t") - F.col("k") * 7_777_777)
    return ev(spark, d).select("id", mins.alias("mins"), S.capped(F.when(F.col("k") > 50, mins / 60), 0.15).alias("hours"))


@bind("prj14_normalise", sql="SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS name FROM part")
def prj14(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalise(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("name"))


@bind("prj15_key_parts", sql="""
    SELECT c_custkey, regexp_extract(cs, '^([A-Z]{3})', 1) AS prefix, regexp_extract(cs, '^([A-Z0-9]{2}[A-Z]?)[0-9]', 1) AS designator,
           regexp_extract(cs, '([0-9]+[A-Z]*)$', 1) AS number
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1
                 THEN substr(c_mktsegment, 1, 2) || CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS cs FROM customer)""")
def prj15(spark, d):
    n = F.col("c_custkey")
    cs = (F.when(n % 3 == 0, F.upper("c_name")).when(n % 3 == 1, F.concat(F.substring("c_mktsegment", 1, 2), n.cast("string")))
          .otherwise(F.col("c_mktsegment")))
    return table(spark, d, "customer").select(
        "c_custkey", S.key_part(cs, S.ALPHA_PREFIX).alias("prefix"), S.key_part(cs, S.DESIGNATOR).alias("designator"),
        S.key_part(cs, S.TRAILING_NUMBER).alias("number"))


@bind("prj16_guessed_key", sql="""
    SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') || regexp_extract(c_name, '([0-9]+[A-Z]*)$', 1) AS guess FROM customer""")
def prj16(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.guessed_key(F.nullif("c_mktsegment", F.lit("BUILDING")), "c_name").alias("guess"))


@bind("prj17_planar_metres", uses="ev pt", sql="""
    SELECT seq, round(sqrt(pow((lat - 0.05) * 111320.0, 2) + pow((lon - 0.04) * 111320.0 * cos(radians(lat)), 2)), 4) AS metres
    FROM pt""")
def prj17(spark, d):
    return pt(spark, d).select("seq", six(S.planar_metres("lat", "lon", F.lit(0.05), F.lit(0.04)), "metres", 4))


SITES = {"A": (0.02, 0.02), "B": (0.05, 0.05), "C": (0.09, 0.03)}


@bind("prj18_site_of", uses="ev pt", sql="""
    SELECT seq, CASE WHEN abs(lat - 0.02) <= 0.02 AND abs(lon - 0.02) <= 0.03 THEN 'A'
                     WHEN abs(lat - 0.05) <= 0.02 AND abs(lon - 0.05) <= 0.03 THEN 'B'
                     WHEN abs(lat - 0.09) <= 0.02 AND abs(lon - 0.03) <= 0.03 THEN 'C' END AS site FROM pt""")
def prj18(spark, d):
    return pt(spark, d).select("seq", S.site_of("lat", "lon", SITES, 0.02, 0.03).alias("site"))


@bind("prj18_site_join", uses="ev pt", sql="""
    SELECT p.*, s.site FROM (SELECT seq, lat, round(lon, 9) AS lon FROM pt) p LEFT JOIN (
        SELECT seq, arg_min('P' || CAST(p_partkey AS VARCHAR), (p_size, 'P' || CAST(p_partkey AS VARCHAR))) AS site
        FROM pt JOIN part ON abs(lat - p_partkey % 101 / 1000.0::DOUBLE) <= 0.0006 AND abs(lon - p_partkey % 163 / 1000.0::DOUBLE) <= 0.0009
        GROUP BY 1) s ON s.seq = p.seq""")
def prj18_join(spark, d):
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    places = table(spark, d, "part").select(name.alias("site"), (F.col("p_partkey") % 101 / 1000).alias("lat"), (F.col("p_partkey") % 163 / 1000).alias("lon"), F.col("p_size").alias("rank"))
    return sites.site_join(pt(spark, d).select("seq", "lat", "lon"), places, 0.0006, 0.0009).select("seq", "lat", six("lon", "lon", 9), "site")


@bind("prj19_safe_ratio", sql="SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem")
def prj19(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.safe_ratio("l_tax", "l_discount").alias("ratio"))


@bind("prj20_exclude", sql="SELECT * EXCLUDE (p_type, p_size) FROM part")
def prj20(spark, d):
    return table(spark, d, "part").drop("p_type", "p_size")


@bind("prj21_missing_category", uses="mx", sql="SELECT id, coalesce(CAST(CAST(d AS BIGINT) AS VARCHAR), '__NA__') AS cat FROM mx")
def prj21(spark, d):
    return mx(spark, d).select("id", S.category(F.col("d").cast("long")).alias("cat"))


@bind("prj22_presence", sql="""
    SELECT c_custkey, CAST(n IS NOT NULL AS BIGINT) AS present FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey""")
def prj22(spark, d):
    urgent = (table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
              .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left").select("c_custkey", S.presence("n").alias("present"))


# --- joins and sets ----------------------------------------------------------------------------

@bind("jn1_join_features", sql="""
    SELECT c_custkey, c_acctbal, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS p FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def jn1(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    a = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    b = o.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("p"))
    return setops.join_features(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [a, b], "c_custkey")


_LEVELS = """
    f3 AS (SELECT site, stand, rwy, avg(y) AS p FROM gr WHERE fit GROUP BY ALL HAVING count(*) >= 10),
    f2 AS (SELECT site, rwy, avg(y) AS p FROM gr WHERE fit GROUP BY ALL),
    f1 AS (SELECT site, avg(y) AS p FROM gr WHERE fit GROUP BY ALL)"""


@bind("jn2_fallback_lookup", uses="gr", sql=f"""
    WITH {_LEVELS}
    SELECT v.id, round(coalesce(f3.p, f2.p, f1.p, 0), 4) AS pred FROM gr v
    LEFT JOIN f3 ON f3.site = v.site AND f3.stand = v.stand AND f3.rwy = v.rwy
    LEFT JOIN f2 ON f2.site = v.site AND f2.rwy = v.rwy LEFT JOIN f1 ON f1.site = v.site WHERE NOT v.fit""")
def jn2(spark, d):
    g = gr(spark, d)
    tables = groups.mean_levels(g.where("fit"), groups.SITE_LEVELS, "y", (10, 1, 1))
    return setops.fallback_lookup(g.where("NOT fit"), tables, 0.0, "pred").select("id", six("pred", "pred", 4))


@bind("jn5_join_on_slot", uses="ev", sql="""
    WITH h AS (SELECT key, t - t % 3600000000 AS slot, count(*) AS n FROM ev WHERE kind = 'view' GROUP BY ALL)
    SELECT e.id, CAST(h.n AS BIGINT) AS n FROM ev e LEFT JOIN h ON h.key = e.key AND h.slot = e.t - e.t % 3600000000""")
def jn5(spark, d):
    from rampwise.operators.trailing import bucket_totals
    e = ev(spark, d)
    hours = bucket_totals(e.where("kind = 'view'"), "key", "t", "val").select("key", F.col("bucket").alias("slot"), "n")
    return setops.join_on_slot(e, hours, "key", "t", "slot", 3600).select("id", "n")


@bind("jn9_without", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (
        SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)""")
def jn9(spark, d):
    li = table(spark, d, "lineitem")
    return setops.without(li, li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@bind("jn10_difference_counts", sql="""
    SELECT CAST((SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 10 FROM orders)) AS BIGINT) AS missing,
           CAST((SELECT count(*) FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)) AS BIGINT) AS extra""")
def jn10(spark, d):
    c = table(spark, d, "customer")
    orders = table(spark, d, "orders").select((F.col("o_custkey") + 10).alias("c_custkey"))
    return setops.difference_counts(c, orders, "c_custkey").select("missing", "extra")


@bind("jn11_membership", sql="""
    SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'open' ELSE 'closed' END
           AS label FROM customer""")
def jn11(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return setops.membership(table(spark, d, "customer"), pending, "c_custkey", "open", "closed", "label").select("c_custkey", "label")


@bind("jn12_offsets", uses="ev", sql="""
    SELECT id, t // 600000000 + CAST(o AS BIGINT) AS slot FROM ev, (SELECT unnest([-1, 0, 1]) AS o)""")
def jn12(spark, d):
    out = setops.with_offsets(ev(spark, d), [-1, 0, 1], "o")
    return out.select("id", big(F.floor(F.col("t") / 600_000_000) + F.col("o"), "slot"))


@bind("jn13_typed_union", uses="ev", sql="""
    SELECT key, t, 'ask' AS kind, id, NULL::DOUBLE AS val FROM ev WHERE kind = 'click'
    UNION ALL SELECT key, t, 'buy', NULL, val FROM ev WHERE kind = 'purchase'
    UNION ALL SELECT key, t, 'see', NULL, NULL FROM ev WHERE kind = 'view'""")
def jn13(spark, d):
    e = ev(spark, d)
    pick = lambda kind, label, *cols: e.where(F.col("kind") == kind).select("key", "t", F.lit(label).alias("kind"), *cols)
    return setops.typed_union([pick("click", "ask", "id"), pick("purchase", "buy", "val"), pick("view", "see")]).select(
        "key", "t", "kind", "id", "val")


@bind("jn14_distinct_after_join", sql="""
    SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def jn14(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("o_custkey", "l_suppkey").dropDuplicates()


@bind("jn15_per_group_subquery", uses="gr", sql="""
    SELECT a.site, round(avg(a.y), 4) AS fit_mean, round((SELECT avg(b.y) FROM gr b WHERE NOT b.fit AND b.site = a.site), 4) AS val_mean
    FROM gr a WHERE a.fit GROUP BY a.site""")
def jn15(spark, d):
    g = gr(spark, d)
    return g.groupBy("site").agg(six(F.avg(F.when(F.col("fit"), F.col("y"))), "fit_mean", 4),
                                 six(F.avg(F.when(~F.col("fit"), F.col("y"))), "val_mean", 4))


@bind("jn16_reoccupied", uses="iv", sql="""
    WITH x AS (SELECT row_number() OVER () AS rn, o_custkey % 200 AS key, epoch_us(o_orderdate) AS s, epoch_us(l_shipdate) AS e,
                      l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
         ev2 AS (SELECT o_custkey % 200 AS key, epoch_us(o_orderdate) AS t FROM orders),
         hits AS (SELECT x.rn, min(v.t) AS t FROM x JOIN ev2 v ON v.key = x.key AND v.t > x.s AND v.t < x.e GROUP BY 1)
    SELECT x.id, h.t IS NOT NULL AS taken, (x.e - h.t) / 1000000 AS lead FROM x LEFT JOIN hits h USING (rn)""")
def jn16(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = (F.col("o_custkey") % 200).alias("key")
    spans = li.join(o, li.l_orderkey == o.o_orderkey).select(
        key, "o_orderdate", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return setops.reoccupied(spans, o.select(key, "o_orderdate"), "key", "id", "o_orderdate", "l_shipdate", "o_orderdate", 30 * 86400)
