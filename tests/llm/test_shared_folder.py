"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from levelforge.llm.common import shared_dir


def session(local, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(_jsc=SimpleNamespace(isLocal=lambda: local)))


def test_clusters_need_a_shared_folder():
    with pytest.raises(ValueError):
        shared_dir(session(False))
    assert shared_dir(session(False, "hdfs://h/x/")).startswith("hdfs://h/x/")
    assert shared_dir(session(True)).startswith("file://")
