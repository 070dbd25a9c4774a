"""The shared folder: never a folder of one machine on a cluster, and cut tables come back whole."""

from types import SimpleNamespace

import pytest

from emberline.session import drop_path, reliable_cut, scratch_path, shared_folder


def fake(master, checkpoint=None, **conf):
    state = {"dir": None}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d)
    )
    settings = {"spark.checkpoint.dir": checkpoint, **conf}
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, default=None: settings.get(k) or default))


def test_a_set_folder_is_used():
    assert shared_folder(fake("yarn", "hdfs://n/shared")) == "hdfs://n/shared"


def test_local_warehouse_off_local_mode_raises():
    for warehouse in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError):
            shared_folder(fake("yarn", **{"spark.sql.warehouse.dir": warehouse}))
        with pytest.raises(ValueError):
            shared_folder(fake("local-cluster[2,1,1024]", **{"spark.sql.warehouse.dir": warehouse}))


def test_shared_warehouse_serves():
    assert shared_folder(fake("yarn", **{"spark.sql.warehouse.dir": "hdfs://n/w"})) == "hdfs://n/w/_checkpoints"


def test_cut_and_drop(spark):
    cut = reliable_cut(spark.range(5))
    assert cut.count() == 5
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    drop_path(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
