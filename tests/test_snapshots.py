"""Keyed tables with snapshots."""

import threading

import pytest

from lodestrand.sources.snapshots import ChangedMeanwhile, SnapshotTable


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k string, v int")


def held(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_upsert_delete_and_old_snapshots(spark, tmp_path):  # K2, K5, K6, K8
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"], 4)
    with pytest.raises(ValueError, match="no snapshot"):
        t.read()
    assert t.upsert(rows(spark, ("a", 1), ("b", 2), ("c", 3))) == 1
    assert t.upsert(rows(spark, ("a", 9), ("d", 4))) == 2
    assert held(t.read()) == [("a", 9), ("b", 2), ("c", 3), ("d", 4)]
    assert held(t.read(1)) == [("a", 1), ("b", 2), ("c", 3)]
    from pyspark.sql import functions as F

    assert t.delete(F.col("v") > 3) == 3 and held(t.read()) == [("b", 2), ("c", 3)]
    assert t.delete(F.col("v") > 100) == 4 and held(t.read()) == [("b", 2), ("c", 3)]
    assert t.replace(rows(spark, ("z", None))) == 5 and held(t.read()) == [("z", None)]
    # a table opened anew is the same
    assert held(SnapshotTable(spark, str(tmp_path / "t"), ["k"]).read(2))[0] == ("a", 9)
    t.vacuum(2)
    assert t.versions() == [4, 5] and held(t.read(4)) == [("b", 2), ("c", 3)]
    t.replace(rows(spark).limit(0))
    assert held(t.read()) == []


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"], 16)
    t.upsert(spark.range(500).selectExpr("cast(id as string) as k", "cast(id as int) as v"))
    before = t.snapshot()["folders"]
    t.upsert(rows(spark, ("7", -7)))
    after = t.snapshot()["folders"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert t.read().count() == 500 and t.read().where("v < 0").count() == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    t, u = (SnapshotTable(spark, str(tmp_path / "t"), ["k"], 2) for _ in range(2))
    t.upsert(rows(spark, ("a", 1)))
    old = u.snapshot()
    t.upsert(rows(spark, ("a", 2)))
    u.snapshot = lambda version=None: old  # it has read before the other wrote
    with pytest.raises(ChangedMeanwhile):
        u.upsert(rows(spark, ("a", 3)))
    assert held(t.read()) == [("a", 2)] and t.versions() == [1, 2]
    assert not [f for f in (tmp_path / "t" / "snapshots").iterdir() if f.name.startswith("_")]


def test_readers_during_upserts(spark, tmp_path):
    t, failed, seen, done = SnapshotTable(spark, str(tmp_path / "t"), ["k"], 2), [], set(), threading.Event()
    t.upsert(rows(spark, ("a", 0), ("b", 0)))

    def read():
        while not done.is_set():
            try:
                got = held(t.read())
                seen.add(len({v for _, v in got}) == 1 and len(got) == 2)
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 8):
        t.upsert(rows(spark, ("a", k), ("b", k)))
    done.set()
    reader.join()
    assert not failed and seen == {True} and held(t.read()) == [("a", 7), ("b", 7)]
