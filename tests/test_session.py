"""The shared folder of a session."""

from types import SimpleNamespace

import pytest

from tidewright.session import shared_dir


def session(master, named=None):
    conf = SimpleNamespace(get=lambda key, other=None: named, set=lambda key, value: None)
    context = SimpleNamespace(master=master, getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert "tidewright-" in shared_dir(session("local[4]"))
