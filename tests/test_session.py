import os

import pytest

from millrace import session as S


class Cluster:
    """As much of a session as `shared_folder` looks at."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder
        self.conf = self.sparkContext = self._jsc = self

    def get(self, key, default):
        return self.folder or default

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return False


def files(table):
    return os.path.exists(table._written_to.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            S.shared_folder(Cluster(master))
        assert S.shared_folder(Cluster(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert S.is_local("local") and S.is_local("local[8]") and not S.is_local("local-cluster[2,1,1024]")


def test_tables_go_with_their_workspace(spark):
    outside = S.written(spark.range(3))
    with S.workspace(spark):
        kept = S.written(spark.range(5))
        with S.workspace(spark):
            inner = S.written(spark.range(7))
            assert inner.count() == 7
        assert not files(inner) and kept.count() == 5
    assert not files(kept) and outside.count() == 3
    S.discard(outside)
    assert not files(outside)
    S.discard(spark.range(1))


def test_a_folder_per_value(spark):
    table = S.written(spark.range(6).selectExpr("id", "id % 2 = 0 as even"), "even")
    assert sorted(r["id"] for r in table.where("even").collect()) == [0, 2, 4]
    assert "PartitionFilters: [isnotnull(even" in table.where("even")._jdf.queryExecution().toString()
