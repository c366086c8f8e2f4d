"""Registry of bound queries and the relations they share.

Every relation exists twice: as a DataFrame over the whole table and as the text of
a common table expression with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rampwise.session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The schema is read from the footers once; later scans of the same table are given it."""
    path = f"{d}/{name}.parquet"
    reader = pin_utc(spark).read
    if path in _SCHEMAS:
        return reader.schema(_SCHEMAS[path]).parquet(path)
    df = reader.parquet(path)
    _SCHEMAS[path] = df.schema
    return df


def bind(name: str, sql: str | None = None, uses: str = ""):
    """Register `fn(spark, dir)` and its oracle; `uses` names the relations the SQL needs."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ctes = [f"{u} AS ({SQL[u]})" for u in uses.split()]
            body = sql.strip()
            if ctes and body[:5].upper() == "WITH ":
                body = "WITH " + ", ".join(ctes) + ", " + body[5:]
            elif ctes:
                body = "WITH " + ", ".join(ctes) + " " + body
            ORACLES[name] = body
        return fn
    return add


def big(column, name: str):
    return (F.col(column) if isinstance(column, str) else column).cast("long").alias(name)


def six(column, name: str, places: int = 6):
    return F.round((F.col(column) if isinstance(column, str) else column).cast("double"), places).alias(name)


SQL: dict[str, str] = {}

# --- events as one stream per key -------------------------------------------------
SQL["ev"] = """
    SELECT event_id AS id, user_id % 10 AS key, user_id AS usr, epoch_us(ts) AS t,
           event_type AS kind, value / 6.1803398875 AS val,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
    FROM events"""


def ev(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("key"), F.col("user_id").alias("usr"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("kind"),
        (F.col("value") / 6.1803398875).alias("val"), F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- intervals from order date to ship date --------------------------------------
SQL["iv"] = """
    SELECT o_orderpriority AS key, epoch_us(o_orderdate) AS s, epoch_us(l_shipdate) AS e,
           l_orderkey * 10 + l_linenumber AS id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def iv(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("key"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("s"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("e"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


# --- grouped targets: fit rows before 2000, validation rows after -------------------
SQL["gr"] = """
    SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS site, l_linestatus AS rwy,
           l_partkey AS stand, l_suppkey AS sup, l_extendedprice / 6.1803398875 AS y, l_quantity AS qty,
           year(l_shipdate) AS yr, month(l_shipdate) AS mon, year(l_shipdate) < 2000 AS fit
    FROM lineitem"""


def gr(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("site"),
        F.col("l_linestatus").alias("rwy"), F.col("l_partkey").alias("stand"), F.col("l_suppkey").alias("sup"),
        (F.col("l_extendedprice") / 6.1803398875).alias("y"), F.col("l_quantity").alias("qty"),
        F.year("l_shipdate").cast("long").alias("yr"), F.month("l_shipdate").cast("long").alias("mon"),
        (F.year("l_shipdate") < 2000).alias("fit"))


# --- two-regime targets --------------------------------------------------------------
SQL["mx"] = """
    SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS site, l_linestatus = 'O' AS matched,
           l_suppkey AS stand, l_linestatus AS rwy, l_quantity AS y, month(l_shipdate) AS mon,
           CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 50 AS DOUBLE) END AS d,
           year(l_shipdate) < 2000 AS fit
    FROM lineitem"""


def mx(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("site"),
        (F.col("l_linestatus") == "O").alias("matched"), F.col("l_suppkey").alias("stand"),
        F.col("l_linestatus").alias("rwy"), F.col("l_quantity").alias("y"),
        F.month("l_shipdate").cast("long").alias("mon"),
        F.when(F.col("l_suppkey") % 7 != 0, (F.col("l_partkey") % 50).cast("double")).alias("d"),
        (F.year("l_shipdate") < 2000).alias("fit"))


# --- events as weather observations -----------------------------------------------
SQL["wx"] = """
    SELECT id, key, t, val - 7 AS temp, CASE WHEN k < 20 THEN CAST(k AS DOUBLE) END AS precip,
           upper(kind) AS code, val / 3 AS vis, k AS wind
    FROM ev"""


def wx(spark, d):
    return ev(spark, d).select(
        "id", "key", "t", (F.col("val") - 7).alias("temp"),
        F.when(F.col("k") < 20, F.col("k").cast("double")).alias("precip"), F.upper("kind").alias("code"),
        (F.col("val") / 3).alias("vis"), F.col("k").alias("wind"))


def rolling_sql(name: str, source: str, key: str, code: str) -> str:
    """Names of the relations of weather frames: `source` is reduced to instants, and each instant is joined with those of the twelve hours up to it."""
    SQL[f"{name}_at"] = f"""
    SELECT {key}, t, count(*) AS n, sum(coalesce(precip, 0)) AS rain, coalesce(sum(precip) FILTER (WHERE temp <= 3), 0) AS cold_rain,
           count(*) FILTER (WHERE temp <= 3 AND (precip > 0 OR regexp_matches({code}, 'SI|PU'))) AS icy,
           min(temp) AS low, min(vis) AS near, sum(vis) AS seen, count(vis) AS n_seen, coalesce(bool_or(temp > 0), false) AS warm
    FROM {source} GROUP BY ALL"""
    SQL[f"{name}_rolled"] = f"""
    SELECT o.*, f.* EXCLUDE ({key}, t), thaws.t AS thaw
    FROM {source} o JOIN (
        SELECT now.{key}, now.t, sum(p.rain) AS p12, sum(p.cold_rain) AS pc12, min(p.low) AS tm12,
               sum(p.rain) FILTER (WHERE in6) AS p6, sum(p.icy) FILTER (WHERE in6) / sum(p.n) FILTER (WHERE in6) AS df6,
               min(p.near) FILTER (WHERE in3) AS vm3, sum(p.seen) FILTER (WHERE in3) / sum(p.n_seen) FILTER (WHERE in3) AS va3
        FROM {name}_at now JOIN (SELECT * FROM {name}_at) p ON p.{key} = now.{key} AND p.t BETWEEN now.t - 43200000000 AND now.t,
             LATERAL (SELECT now.t - p.t <= 21600000000 AS in6, now.t - p.t <= 10800000000 AS in3)
        GROUP BY 1, 2) f ON f.{key} = o.{key} AND f.t = o.t
    ASOF LEFT JOIN (SELECT {key}, t FROM {name}_at WHERE warm) thaws ON thaws.{key} = o.{key} AND thaws.t <= o.t"""
    return f"{name}_at {name}_rolled"


# --- events of a user as positions ---------------------------------------------------
SQL["pt"] = """
    SELECT usr, t, id AS seq, kind <> 'error' AS ground, 'S' || CAST(k // 25 AS VARCHAR) AS site,
           val / 2 AS gs, k / 1000 AS lat, val / 1000 AS lon,
           CASE WHEN k % 3 = 0 THEN 'C' || CAST(k % 7 AS VARCHAR) END AS callsign
    FROM ev"""


def pt(spark, d):
    return ev(spark, d).select(
        "usr", "t", F.col("id").alias("seq"), (F.col("kind") != "error").alias("ground"),
        F.concat(F.lit("S"), F.floor(F.col("k") / 25).cast("string")).alias("site"),
        (F.col("val") / 2).alias("gs"), (F.col("k") / 1000).alias("lat"), (F.col("val") / 1000).alias("lon"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("C"), (F.col("k") % 7).cast("string"))).alias("callsign"))


# --- events as site movements, in the shape the departure jobs read ---------------------
SQL["mv"] = """
    SELECT *, CASE WHEN phase = 'DEP' THEN fin - start ELSE start - fin END AS y
    FROM (
        SELECT *, CASE WHEN phase = 'ARR' THEN fin + taxi
                       WHEN id % 11 = 0 AND sched IS NOT NULL THEN sched ELSE fin - taxi END AS start,
               ref - (id % 5) * 120 AS lobt, ref - (id % 6) * 90 AS iobt, ref - (id % 9 - 4) * 60 AS eobt,
               CASE WHEN phase = 'ARR' AND id % 8 <> 0 THEN fin - (id % 21 - 10) * 20 END AS arvt
        FROM (
            SELECT *, CASE WHEN id % 13 <> 0 THEN fin - taxi - (id % 7 - 3) * 30 END AS ref,
                   CASE WHEN id % 29 <> 0 THEN fin - 300 - id * 37 % 3000 END AS sched
            FROM (SELECT id, CASE WHEN kind IN ('click', 'view') THEN 'DEP' ELSE 'ARR' END AS phase,
                         t // 1000000 AS fin, 300 + k * 15 AS taxi, 'A' || CAST(key AS VARCHAR) AS site,
                         'S' || CAST(usr % 50 AS VARCHAR) AS stand, 'R' || CAST(k % 3 AS VARCHAR) AS rwy,
                         'T' || CAST(k % 11 AS VARCHAR) AS actype, 'P' || CAST(id % 17 AS VARCHAR) AS operator
                  FROM ev)))"""


def movements(spark, d):
    """Raw movements with timestamps; see `SQL["mv"]` for the same in epoch seconds."""
    e = ev(spark, d)
    at = lambda s: F.timestamp_seconds(s)
    base = e.select(
        "id", F.when(F.col("kind").isin("click", "view"), "DEP").otherwise("ARR").alias("phase"),
        ((F.col("t") - F.pmod(F.col("t"), F.lit(1_000_000))) / 1_000_000).cast("long").alias("fin"),
        (300 + F.col("k") * 15).alias("taxi"), F.concat(F.lit("A"), F.col("key").cast("string")).alias("site"),
        F.concat(F.lit("S"), (F.col("usr") % 50).cast("string")).alias("stand"),
        F.concat(F.lit("R"), (F.col("k") % 3).cast("string")).alias("rwy"),
        F.concat(F.lit("T"), (F.col("k") % 11).cast("string")).alias("actype"),
        F.concat(F.lit("P"), (F.col("id") % 17).cast("string")).alias("operator"), F.col("k").cast("string").alias("number"))
    base = base.withColumn("ref", F.when(F.col("id") % 13 != 0, F.col("fin") - F.col("taxi") - (F.col("id") % 7 - 3) * 30))
    base = base.withColumn("sched", F.when(F.col("id") % 29 != 0, F.col("fin") - 300 - F.col("id") * 37 % 3000))
    base = base.withColumn(
        "start", F.when(F.col("phase") == "ARR", F.col("fin") + F.col("taxi"))
        .when((F.col("id") % 11 == 0) & F.col("sched").isNotNull(), F.col("sched"))
        .otherwise(F.col("fin") - F.col("taxi")))
    dep = F.col("phase") == "DEP"
    away = F.concat(F.lit("X"), F.col("site"))
    letter = lambda first, n: F.char((F.lit(first) + F.col("id") % n).cast("int"))
    return base.select(
        F.col("id").alias("MVT_ID_mvt"), F.col("phase").alias("PHASE_mvt"),
        F.when(dep, F.col("site")).otherwise(away).alias("ADEP_mvt"),
        F.when(dep, away).otherwise(F.col("site")).alias("ADES_mvt"),
        at("fin").alias("MVT_TIME_UTC_mvt"), at("start").alias("BLOCK_TIME_UTC_mvt"),
        at("sched").alias("SCHED_TIME_UTC_mvt"), at("ref").alias("AOBT_3_flt"),
        at(F.col("ref") - (F.col("id") % 5) * 120).alias("LOBT_flt"),
        at(F.col("ref") - (F.col("id") % 6) * 90).alias("IOBT_flt"),
        at(F.col("ref") - (F.col("id") % 9 - 4) * 60).alias("EOBT_1_flt"),
        at(F.when(~dep & (F.col("id") % 8 != 0), F.col("fin") - (F.col("id") % 21 - 10) * 20)).alias("ARVT_3_flt"),
        F.when(dep, F.col("fin") - F.col("start")).otherwise(F.col("start") - F.col("fin")).cast("double").alias("TAXITIME_SEC_mvt"),
        F.col("stand").alias("STAND_mvt"), F.col("rwy").alias("RUNWAY_mvt"), F.col("actype").alias("AIRCRAFT_TYPE_mvt"),
        F.lit("M").alias("WK_TBL_CAT_flt"), F.col("operator").alias("AIRCRAFT_OPERATOR_flt"),
        F.lit("Scheduled").alias("MARKET_SEGMENT_flt"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit(" aa"), letter(65, 17), "number")).alias("CALLSIGN_flt"),
        F.concat(letter(75, 15), F.lit("X"), "number").alias("FLIGHT_mvt"))
