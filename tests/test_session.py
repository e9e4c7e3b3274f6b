"""Session rules: the shared checkpoint folder comes from the session when it is set."""

from tidewater import session, util


def test_checkpoint_root_uses_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_root(spark) == configured
    path = session.scratch_path(spark, "x")
    assert path.startswith(configured.rstrip("/") + "/x-")


def test_materialize_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice").where("id % 3 = 0")
    m = util.materialize(df)
    assert m.count() == 34
    plan = m._jdf.queryExecution().logical().toString()
    assert "Filter" not in plan      # the checkpointed copy has no upstream operators


def test_runtime_settings_applied(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"


def test_a_cluster_needs_a_shared_folder():
    """Without spark.checkpoint.dir only a local master may fall back to a temp folder."""
    import pytest

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_root(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


def test_reading_tables_leaves_the_session_alone(spark):
    from conftest import SMOKE
    from tidewater.sources.tables import read_table
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        read_table(spark, SMOKE, "region").count()
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_two_writers_of_a_snapshot(spark, tmpdir_path):
    """Both read the same last id; neither overwrites the other, readers agree on one."""
    from tidewater import store
    path = f"{tmpdir_path}/t"
    store.write_snapshot(spark.range(1), path)
    ids = [store._next(spark, path) for _ in range(2)]
    assert ids[0][0] == ids[1][0] and ids[0][1] != ids[1][1]
    for n, (_, p) in zip((2, 3), ids):
        spark.range(n).write.parquet(p)
    first = store.read_current(spark, path).count()
    assert first in (2, 3) and store.read_current(spark, path).count() == first
    store.drop_old_snapshots(spark, path, keep=1)
    assert store.read_current(spark, path).count() == first


def test_group_becomes_current_as_one(spark, tmpdir_path):
    import glob
    import os

    from tidewater import store
    root = f"{tmpdir_path}/g"
    store.write_group({"a": spark.range(1), "b": spark.range(2)}, root)
    store.write_group({"a": spark.range(3), "b": spark.range(4)}, root)
    assert store.read_group(spark, root, "b").count() == 4
    os.remove(sorted(glob.glob(f"{root}/snap=2-*/_SUCCESS"))[0])   # broke off before the marker
    assert store.read_group(spark, root, "a").count() == 1
    assert store.read_group(spark, root, "b").count() == 2
    assert store.read_group_history(spark, root, "b", "id long").count() == 2
