from types import SimpleNamespace

import pytest

from patchloom.session import shared_dir


def session(master, folder):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="app"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError):
        shared_dir(session(master, None))
    assert shared_dir(session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_one_machine_may_do_without(tmp_path):
    assert shared_dir(session("local[4]", None)) == shared_dir(session("local", None))
