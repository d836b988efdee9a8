import pytest

from vetch.llm import common


class Stub:
    """A session of a master, with what spark.checkpoint.dir says."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf, self.master, self.folder, self.set = self, self, master, folder, None

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.set

    def setCheckpointDir(self, folder):
        self.set = folder


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,3000]", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Stub(master))
    assert common.shared_folder(Stub(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_master_gets_a_folder_of_its_own():
    assert common.shared_folder(Stub("local[4]")) and common.shared_folder(Stub("local"))


def test_components_of_a_chain_and_a_hub(spark):
    chain, hub = [(k, k + 1) for k in range(30)], [(100, k) for k in range(101, 160)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame([*chain, *hub, (500, 500), (None, 7)], "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 160)}}
