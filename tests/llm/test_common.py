import os

import pytest

from loomcell.llm import common


class Session:
    """As much of a session as ``shared_dir`` asks for."""

    def __init__(self, master, named=None):
        self.sparkContext = self
        self.conf = self
        self.master, self.named, self.put = master, named, {}

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.put.get(key, self.named)

    def set(self, key, value):
        self.put[key] = value


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Session(master))
        assert common.shared_dir(Session(master, "hdfs:///shared")) == "hdfs:///shared"
    one = Session("local[4]")
    assert common.shared_dir(one) == common.shared_dir(one)


def test_written_tables_can_be_discarded(spark):
    df = common.materialise(spark.range(5), "a b%")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5
    common.discard(df)
    assert not os.path.exists(os.path.dirname(path))
