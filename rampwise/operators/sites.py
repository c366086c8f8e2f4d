"""Points and the boxes of many sites: one probe of a cell for each point."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells are wider than their share of a box by this much, so that rounding never reaches past the cells a box is dealt to.
WIDER = 1.001


def site_table(spark: SparkSession, sites: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(site, lat, lon, rank) from a mapping, in its order."""
    rows = [(name, float(lat), float(lon), i) for i, (name, (lat, lon)) in enumerate(sites.items())]
    return spark.createDataFrame(rows, "site string, lat double, lon double, rank long")


def _cell(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def _cells(x: Column, reach: float, width: float) -> Column:
    """All cells that a box from x - reach to x + reach may touch."""
    slack = reach * (WIDER - 1)
    return F.explode(F.sequence(_cell(x - reach - slack, width), _cell(x + reach + slack, width)))


def site_join(points: DataFrame, sites: DataFrame, dlat: float = 0.06, dlon: float = 0.09, parts: int = 2,
              lat: str = "lat", lon: str = "lon", out: str = "site") -> DataFrame:
    """The points with the site of least rank whose box holds them, null outside all.

    `sites` has site, lat, lon and rank; equal ranks go by name; sites without a place or a name are left out. Boxes are dealt to
    the cells they touch, `parts` cells to half a box, and each cell keeps its sites in order of rank up to the first that covers it whole,
    as none behind that one can win there. Each point then meets one row: points are neither copied nor grouped. Cells are a table as small as
    the sites; adaptive execution broadcasts it by its measured size and splits a hot cell otherwise. A point without a place, or with
    NaN, has no site. A column of points called `out` is replaced.
    """
    high, wide = dlat / parts * WIDER, dlon / parts * WIDER
    known = sites.where("site IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").select("site", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "rank")
    dealt = known.select("*", _cells(F.col("lat"), dlat, high).alias("_row")).select("*", _cells(F.col("lon"), dlon, wide).alias("_col"))
    within = lambda place, reach, cell, width: ((cell * width >= place - reach * (2 - WIDER)) & ((cell + 1) * width <= place + reach * (2 - WIDER)))
    covers = within(F.col("lat"), dlat, F.col("_row"), high) & within(F.col("lon"), dlon, F.col("_col"), wide)
    order = F.struct("rank", "site")
    first = F.min(F.when(covers, order)).over(Window.partitionBy("_row", "_col"))
    kept = dealt.withColumn("_first", first).where(F.col("_first").isNull() | (order <= F.col("_first")))
    cells = kept.groupBy("_row", "_col").agg(F.array_sort(F.collect_list(F.struct("rank", "site", "lat", "lon"))).alias("_sites"))
    y, x = F.col(lat), F.col(lon)
    placed = points.withColumns({"_row": F.when(~F.isnan(y), _cell(y, high)), "_col": F.when(~F.isnan(x), _cell(x, wide))})
    met = placed.join(cells, ["_row", "_col"], "left")
    inside = F.filter("_sites", lambda s: (F.abs(y - s["lat"]) <= dlat) & (F.abs(x - s["lon"]) <= dlon))
    return met.withColumn(out, F.get(inside, F.lit(0))["site"]).select(*[c for c in points.columns if c != out], out)
