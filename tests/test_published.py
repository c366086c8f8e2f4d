"""Published days: readers see all of a run or nothing of it."""

import pytest
from pyspark.sql import functions as F

from rampwise.sources import files
from rampwise.sources.published import Folder, publish_days, published, read_published, unread_runs
from tests.conftest import rows


def _days(spark, *pairs):
    return spark.createDataFrame(list(pairs), "day string, x long")


def test_days_are_replaced_and_kept(spark, tmp_path):
    path = str(tmp_path / "out")
    assert published(spark, path).count() == 0 and unread_runs(spark, path) == []
    assert publish_days(_days(spark, ("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-02", 2)), path, "day", "a") == 1
    assert publish_days(_days(spark, ("2024-01-02", 3), ("2024-01-03", 4)), path, "day", "b", 2) == 2
    assert rows(read_published(spark, path)) == [("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-02", 3), ("2024-01-03", 4)]
    assert rows(published(spark, path)) == [("2024-01-01", "a", 1, 2), ("2024-01-02", "b", 2, 1), ("2024-01-03", "b", 2, 1)]
    assert rows(read_published(spark, path, number=1)) == [("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-02", 2)]
    assert rows(read_published(spark, path, where=F.col("version") == 2), "x") == [(3,), (4,)]
    wanted = _days(spark, ("2024-01-01", 0), ("2024-01-03", 0), ("2024-01-04", 0)).select("day")
    assert rows(files.todo(wanted, published(spark, path), 2)) == [("2024-01-01",), ("2024-01-04",)]


def test_a_repeated_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    publish_days(_days(spark, ("d1", 1)), path, "day", "a")
    publish_days(_days(spark, ("d1", 2)), path, "day", "b")
    assert publish_days(_days(spark, ("d1", 9)), path, "day", "a") == 2
    assert rows(read_published(spark, path), "x") == [(2,)] and unread_runs(spark, path) == ["a"]


def test_a_write_that_stops_half_way_leaves_the_old_days(spark, tmp_path):
    path = str(tmp_path / "out")
    publish_days(_days(spark, ("d1", 1), ("d2", 2)), path, "day", "a")
    broken = _days(spark, ("d1", 7), ("d2", 8)).withColumn("x", F.when(F.col("x") == 8, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        publish_days(broken, path, "day", "b")
    assert rows(read_published(spark, path)) == [("d1", 1), ("d2", 2)]
    publish_days(_days(spark, ("d1", 7), ("d2", 8)), path, "day", "b")
    assert rows(read_published(spark, path)) == [("d1", 7), ("d2", 8)]


def test_a_job_lost_before_its_manifest_has_a_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    publish_days(_days(spark, ("d1", 1)), path, "day", "a")
    with monkeypatch.context() as m:
        m.setattr(Folder, "take", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            publish_days(_days(spark, ("d1", 5), ("d2", 6)), path, "day", "b")
    assert rows(read_published(spark, path)) == [("d1", 1)] and unread_runs(spark, path) == ["b"]
    assert publish_days(_days(spark, ("d1", 5), ("d2", 6)), path, "day", "b") == 2
    assert rows(read_published(spark, path)) == [("d1", 5), ("d2", 6)]


def test_of_two_jobs_at_once_neither_is_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    publish_days(_days(spark, ("d1", 1)), path, "day", "a")
    real, seen = Folder.take, []

    def other_first(self, hidden, number):
        if not seen:
            seen.append(number)
            publish_days(_days(spark, ("d2", 2)), path, "day", "other")
        return real(self, hidden, number)

    monkeypatch.setattr(Folder, "take", other_first)
    assert publish_days(_days(spark, ("d3", 3)), path, "day", "mine") == 3
    assert rows(read_published(spark, path)) == [("d1", 1), ("d2", 2), ("d3", 3)]


def test_a_taken_number_is_never_overwritten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    publish_days(_days(spark, ("d1", 1)), path, "day", "a")
    monkeypatch.setattr(Folder, "number", lambda self: 0)
    with pytest.raises(RuntimeError, match="not published"):
        publish_days(_days(spark, ("d1", 2)), path, "day", "b")
    monkeypatch.undo()
    assert rows(read_published(spark, path)) == [("d1", 1)]


def test_empty_and_refused(spark, tmp_path):
    path = str(tmp_path / "out")
    df = _days(spark, ("d1", 1))
    publish_days(df.where("x > 1"), path, "day", "none")
    assert rows(read_published(spark, path, schema=df.schema)) == []
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)
    with pytest.raises(Exception, match="no day"):
        publish_days(df.withColumn("day", F.lit(None).cast("string")), path, "day", "null")
    with pytest.raises(Exception, match="name a folder: a/b"):
        publish_days(df.withColumn("day", F.lit("a/b")), path, "day", "slash")
    for bad in (lambda: publish_days(df.withColumnRenamed("x", "_run"), path, "day", "r"), lambda: publish_days(df, path, "day", "a/b")):
        with pytest.raises(ValueError):
            bad()
    at = spark.sql("SELECT timestamp '2024-05-06 07:08:09' AS day, 1L AS x")
    publish_days(at, path, "day", "times")
    assert rows(published(spark, path), "day") == [("2024-05-06",)] and read_published(spark, path).dtypes == at.dtypes
