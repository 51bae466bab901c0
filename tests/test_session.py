"""Shared checkpoint folder: read from the session, invented only for local sessions."""

import pytest

from jobatlas import session as SES


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):  # noqa: N802 - mirrors SparkContext
        return self.ckpt

    def setCheckpointDir(self, d):  # noqa: N802
        self.ckpt = d


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.conf, self.sparkContext = _Conf(conf or {}), _Context(master, ckpt)


@pytest.fixture(autouse=True)
def _no_cached_folder(monkeypatch):
    monkeypatch.setattr(SES, "_LOCAL_CKPT", None)


def test_session_setting_wins():
    s = _Session("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert SES.ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt"


def test_context_checkpoint_dir_is_used():
    s = _Session("yarn", ckpt="s3a://bucket/ckpt/abc")
    assert SES.ensure_checkpoint_dir(s) == "s3a://bucket/ckpt/abc"


def test_cluster_without_shared_folder_fails():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        SES.ensure_checkpoint_dir(_Session("yarn"))


def test_local_session_gets_a_folder():
    s = _Session("local[2]")
    d = SES.ensure_checkpoint_dir(s)
    assert d and s.conf.get("spark.checkpoint.dir") == d
