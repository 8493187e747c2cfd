from types import SimpleNamespace

import pytest

from logistra import storage


def session(configured=None, known=None, master="yarn"):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: known)
    settings = {"spark.checkpoint.dir": configured}
    conf = SimpleNamespace(get=lambda key, default: settings[key] or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_configured_folder_is_used():
    assert storage.shared_dir(session("hdfs:///shared", "hdfs:///other")) == "hdfs:///shared"
    path = storage.new_table_path(session("hdfs:///shared/"), "model")
    assert path.startswith("hdfs:///shared/logistra/model-")
    assert path != storage.new_table_path(session("hdfs:///shared/"), "model")


def test_a_folder_set_on_the_context_is_used():
    assert storage.shared_dir(session(known="hdfs:///other")) == "hdfs:///other"


def test_a_cluster_without_a_folder_fails():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(session())


def test_a_local_session_gets_a_folder(spark):
    assert storage.shared_dir(spark) == storage.shared_dir(spark)
