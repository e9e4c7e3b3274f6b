"""Commits of several tables, and appends by key."""

import threading

import pytest
from pyspark.sql import functions as F

from tidewater import store
from tidewater.plans import etl


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tables_change_together(spark, tmpdir_path):
    root = f"{tmpdir_path}/r"
    assert store.manifest(spark, root) == (0, {})
    assert store.commit(root, {"a": spark.range(2), "b": spark.range(3)}) == 1
    assert store.commit(root, {"a": spark.range(5)}, {"b": spark.range(10, 11)}) == 2
    assert ids(store.read_current(spark, f"{root}/a")) == [0, 1, 2, 3, 4]
    assert ids(store.read_current(spark, f"{root}/b")) == [0, 1, 2, 10]
    assert ids(store.read_version(spark, f"{root}/a", 1)) == [0, 1]


def test_crash_between_two_tables_shows_neither(spark, tmpdir_path, monkeypatch):
    """The second table's write fails: readers keep the old pair; the retry goes through."""
    c, p = f"{tmpdir_path}/d/cats", f"{tmpdir_path}/d/prods"
    cats = lambda n: spark.range(n).selectExpr("concat('C', id) category_id", "'x' category_name")
    prods = lambda n: spark.range(n).selectExpr(
        "concat('P', id) product_id", "'n' product_name", "'d' description", "concat('C', id) category_id")
    etl.refresh_metadata(spark, cats(2), prods(2), c, p)
    real = store._create_manifest
    monkeypatch.setattr(store, "_create_manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        etl.refresh_metadata(spark, cats(4), prods(4), c, p)
    monkeypatch.setattr(store, "_create_manifest", real)
    assert [store.read_current(spark, x).count() for x in (c, p)] == [2, 2]
    etl.refresh_metadata(spark, cats(4), prods(4), c, p)
    assert [store.read_current(spark, x).count() for x in (c, p)] == [4, 4]
    with pytest.raises(ValueError):
        etl.refresh_metadata(spark, cats(4), prods(4), c, f"{tmpdir_path}/elsewhere/prods")


def test_a_taken_number_is_not_overwritten(spark, tmpdir_path):
    root = f"{tmpdir_path}/r"
    store.commit(root, {"a": spark.range(1)})
    assert not store._create_manifest(spark, root, 1, {"a": ["other"]})
    assert store._create_manifest(spark, root, 2, {"a": ["other"]})
    assert store.manifest(spark, root, 1)[1] != {"a": ["other"]}


def test_a_change_in_between_is_a_conflict(spark, tmpdir_path):
    root = f"{tmpdir_path}/r"
    base = store.commit(root, {"a": spark.range(1), "b": spark.range(1)})
    store.commit(root, {"b": spark.range(2)})
    store.commit(root, {"a": spark.range(3)}, base=base)  # a is as it was: b is taken over
    assert store.read_current(spark, f"{root}/b").count() == 2
    with pytest.raises(store.Conflict):
        store.commit(root, {"a": spark.range(9)}, base=base)
    assert store.read_current(spark, f"{root}/a").count() == 3


def test_two_writers_of_one_key_leave_it_once(spark, tmpdir_path):
    """Appends of the same and of overlapping keys at the same time."""
    path = f"{tmpdir_path}/r/t"
    added, failed = [], []

    def write(lo, hi):
        try:
            added.append(store.append_unique(
                spark.range(lo, hi).withColumn("v", F.lit(lo)), path, ["id"]))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=a) for a in ((0, 50), (0, 50), (25, 80), (60, 90))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert ids(store.read_current(spark, path)) == list(range(90)) and sum(added) == 90


def test_append_unique_rules(spark, tmpdir_path):
    path = f"{tmpdir_path}/r/t"
    rows = spark.createDataFrame([(1, None), (1, "x"), (None, "x")], "k int, id string")
    assert store.append_unique(rows, path, ["k", "id"]) == 3
    assert store.append_unique(rows, path, ["k", "id"]) == 0
    assert store.append_unique(rows.limit(0), path, ["k", "id"]) == 0
    with pytest.raises(ValueError):
        store.append_unique(rows.union(rows), path, ["k", "id"])
    assert store.read_current(spark, path).count() == 3
