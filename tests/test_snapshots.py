"""Versions of a table: readers between writes, failures, conflicts, slices."""

import pytest
from pyspark.sql import functions as F

from emberlane.sources import snapshots

SCHEMA = "series_id string, source string, sec long, value double"
KEYS = ["series_id", "source", "sec"]


def rows(spark, *values):
    return spark.createDataFrame([("s", source, sec, float(v)) for source, sec, v in values], SCHEMA)


def told(df):
    return sorted((r.source, r.sec, r.value) for r in df.collect())


def test_a_reader_keeps_its_version_between_two_writes(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert snapshots.read(spark, path) is None
    snapshots.save(rows(spark, ("a", 0, 1), ("b", 0, 2)), path, KEYS, "source")
    before = snapshots.read(spark, path)
    assert snapshots.save(rows(spark, ("a", 0, 9), ("b", 60, 3)), path, KEYS, "source") == 2
    assert told(before) == [("a", 0, 1.0), ("b", 0, 2.0)]
    assert told(snapshots.read(spark, path)) == [("a", 0, 9.0), ("b", 0, 2.0), ("b", 60, 3.0)]
    assert told(snapshots.read(spark, path, 1)) == told(before)


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    snapshots.save(rows(spark, ("a", 0, 1)), path, KEYS)

    def dies(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", dies)
        with pytest.raises(OSError, match="lost"):
            snapshots.save(rows(spark, ("a", 0, 5)), path, KEYS)
    bad = rows(spark, ("a", 0, 5)).withColumn("value", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        snapshots.save(bad, path, KEYS)
    assert told(snapshots.read(spark, path)) == [("a", 0, 1.0)]
    assert snapshots.vacuum(spark, path, older_than_s=0)
    assert told(snapshots.read(spark, path)) == [("a", 0, 1.0)]


def test_of_two_writers_one_begins_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    base = snapshots.manifest(spark, path)
    folder = snapshots.stage(rows(spark, ("a", 0, 1)), path)
    snapshots.save(rows(spark, ("b", 0, 2)), path, KEYS)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, base, [folder])
    assert told(snapshots.read(spark, path)) == [("b", 0, 2.0)]
    snapshots.save(rows(spark, ("a", 0, 1)), path, KEYS)
    assert told(snapshots.read(spark, path)) == [("a", 0, 1.0), ("b", 0, 2.0)]


def test_new_columns_and_the_last_of_a_stamp(spark, tmp_path):
    path = str(tmp_path / "cache")
    snapshots.save(rows(spark, ("a", 0, 1)), path, KEYS)
    more = rows(spark, ("a", 60, 1), ("a", 60, 2)).withColumns({"seq": F.col("value"), "kind": F.lit("cumulative")})
    snapshots.save(more, path, KEYS)
    assert sorted((r.sec, r.value, r.kind) for r in snapshots.read(spark, path).collect()) == [(0, 1.0, None), (60, 2.0, "cumulative")]


def test_vacuum_keeps_recent_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    for k in range(4):
        snapshots.save(rows(spark, ("a", k, k)), path, KEYS)
    assert snapshots.vacuum(spark, path) == []  # too young
    assert len(snapshots.vacuum(spark, path, keep=2, older_than_s=0)) == 2
    assert snapshots.versions(spark, path) == [3, 4] and len(told(snapshots.read(spark, path))) == 4


def test_slices_land_once_and_the_earlier_wins(spark, tmp_path):
    path = str(tmp_path / "table")
    slices = []
    for k, values in enumerate([[("a", 0, 1), ("a", 60, 2)], [("a", 60, 7), ("a", 120, 3)], [("a", 120, 8), ("a", 180, 4)]]):
        rows(spark, *values).write.parquet(place := str(tmp_path / f"slice{k}"))
        slices.append((f"day{k}", place))
    assert snapshots.land_slices(spark, path, slices[:2], KEYS) == ["day0", "day1"]
    want = [("a", 0, 1.0), ("a", 60, 2.0), ("a", 120, 3.0)]
    assert told(snapshots.read(spark, path)) == want
    assert snapshots.land_slices(spark, path, slices[:2], KEYS) == [] and snapshots.versions(spark, path) == [1]
    assert snapshots.land_slices(spark, path, [*slices, slices[2]], KEYS) == ["day2"]
    assert told(snapshots.read(spark, path)) == [*want, ("a", 180, 4.0)]
    assert snapshots.manifest(spark, path)["slices"] == ["day0", "day1", "day2"]


def test_landed_slices_are_not_read_again(spark, tmp_path):
    path = str(tmp_path / "table")
    rows(spark, ("a", 0, 1)).write.parquet(str(tmp_path / "one"))
    snapshots.land_slices(spark, path, [("one", str(tmp_path / "one"))], KEYS)
    assert snapshots.land_slices(spark, path, [("one", str(tmp_path / "gone"))], KEYS) == []
