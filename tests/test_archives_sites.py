"""Archives read by byte ranges, and the site join against every pair of point and box."""

import gzip
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from rampwise.operators.sites import site_join, site_table
from rampwise.sources.archives import scan_archives, write_archives
from tests.conftest import rows


def _tar(path, docs, form, zipped=True):
    with tarfile.open(path, "w", format=form) as tar:
        for name, text in docs:
            data = gzip.compress(text.encode()) if zipped else text.encode()
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
@pytest.mark.parametrize("step", [512, 3000, 1 << 20])
def test_every_member_is_read_once_however_ranges_fall(spark, tmp_path, form, step):
    pick = random.Random(step)
    docs = [(("n" * pick.choice([5, 120, 300])) + f"-{i}.json", '{"icao":"%s"}' % ("x" * pick.choice([0, 10, 600, 9000]))) for i in range(40)]
    _tar(tmp_path / "a.tar", docs, form, zipped=False)
    _tar(tmp_path / "b.tar", docs[:7], form)
    _tar(tmp_path / "_unfinished.tar", docs, form)
    got = scan_archives(spark, str(tmp_path), step)
    want = sorted([(n, t[9:-2]) for n, t in docs + docs[:7]])
    assert rows(got.select(F.substring_index("path", "#", -1).alias("n"), F.try_variant_get("doc", "$.icao", "string").alias("i"))) == want
    assert got.where("error IS NOT NULL").count() == 0


def test_cut_and_damaged_archives(spark, tmp_path):
    docs = [(f"{i}.json", '{"icao":"%s"}' % ("y" * 2000)) for i in range(5)]
    _tar(tmp_path / "cut.tar", docs, tarfile.USTAR_FORMAT, zipped=False)
    whole = (tmp_path / "cut.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:2560 * 3 + 1000])  # the fourth member ends early, the fifth is gone
    damaged = bytearray(whole)
    damaged[2560 + 10] ^= 1  # the second header no longer meets its checksum
    (tmp_path / "damaged.tar").write_bytes(bytes(damaged))
    _tar(tmp_path / "text.tar", [("bad.json", "{"), ("none.json", "")], tarfile.USTAR_FORMAT)
    _tar(tmp_path / "empty.tar", [], tarfile.USTAR_FORMAT)
    got = scan_archives(spark, str(tmp_path), 1024)
    at = F.regexp_extract("path", r"([a-z]+)\.tar#(.*)", 1)
    found = rows(got.groupBy(at.alias("a"), "error").agg(F.count(F.lit(1)).alias("n")))
    assert found == [("cut", "truncated", 1), ("cut", None, 3), ("damaged", None, 4), ("text", "malformed", 2)]


def test_written_archives_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.range(100).select(F.col("id").alias("name"), F.concat(F.lit('{"icao":"é'), F.col("id"), F.lit('"}')).alias("body"), F.lit(1).alias("other"))
    write_archives(docs.repartition(3), path)
    write_archives(docs.where("id < 0"), path)
    write_archives(docs.where("id = 7").withColumn("body", F.lit(None).cast("string")), path)
    got = scan_archives(spark, path, 2048)
    assert got.groupBy("error").count().sort("error").collect() == [(None, 100), ("malformed", 1)]
    assert got.select(F.try_variant_get("doc", "$.icao", "string").alias("i")).where("i IS NOT NULL").distinct().count() == 100
    with pytest.raises(Exception, match="no name"):
        write_archives(docs.withColumn("name", F.lit(None).cast("string")), path)
    assert scan_archives(spark, path).count() == 101


def test_an_empty_folder_has_no_documents(spark, tmp_path):
    assert scan_archives(spark, str(tmp_path)).count() == 0


def _first(lat, lon, boxes, dlat, dlon):
    held = [(rank, name) for name, y, x, rank in boxes if lat is not None and lon is not None and abs(lat - y) <= dlat and abs(lon - x) <= dlon]
    return min(held)[1] if held else None


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_site_join_equals_all_pairs(spark, parts):
    pick = random.Random(parts)
    boxes = [(f"s{i}", pick.randint(-300, 300) / 100, pick.randint(-300, 300) / 100, pick.randint(0, 40)) for i in range(150)]
    edge = [(y + a * 0.06, x + b * 0.09) for _, y, x, _ in boxes[:40] for a in (-1, 0, 1) for b in (-1, 1)]  # on the sides of boxes
    places = edge + [(pick.uniform(-3.2, 3.2), pick.uniform(-3.2, 3.2)) for _ in range(600)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("nan"))]
    points = spark.createDataFrame([(i, la, lo, "old") for i, (la, lo) in enumerate(places)], "id long, lat double, lon double, site string")
    table = spark.createDataFrame(boxes + [(None, 0.0, 0.0, -1), ("nowhere", None, 0.0, -1)], "site string, lat double, lon double, rank long")
    got = site_join(points, table, parts=parts)
    assert got.columns == ["id", "lat", "lon", "site"]
    assert rows(got, "id", "site") == [(i, _first(la, lo, boxes, 0.06, 0.09)) for i, (la, lo) in enumerate(places)]


def test_site_join_of_ten_thousand_sites_and_of_none(spark):
    many = spark.range(10_000).select(F.concat(F.lit("s"), F.col("id")).alias("site"), (F.floor(F.col("id") / 100) / 2.0).alias("lat"), (F.col("id") % 100 / 2.0).alias("lon"), F.col("id").alias("rank"))
    points = spark.range(20_000).select("id", (F.floor(F.col("id") % 10_000 / 100) / 2.0 + 0.05).alias("lat"), (F.col("id") % 100 / 2.0 - 0.08).alias("lon"))
    assert site_join(points, many).where(F.col("site") == F.concat(F.lit("s"), F.col("id") % 10_000)).count() == 20_000
    assert site_join(points, site_table(spark, {})).where("site IS NULL").count() == 20_000
    assert site_join(points.where("id < 0"), many).count() == 0


def test_sites_that_cannot_win_in_a_cell_are_not_kept(spark):
    """A thousand sites at one place leave one row a cell with one site."""
    boxes = spark.range(1000).select(F.concat(F.lit("s"), F.col("id")).alias("site"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.col("id").alias("rank"))
    points = spark.createDataFrame([(1, 1.01, 2.01)], "id long, lat double, lon double")
    assert rows(site_join(points, boxes, parts=4), "site") == [("s0",)]
