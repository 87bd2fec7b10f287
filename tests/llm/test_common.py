"""Joins of common keys, and the shared folder."""

from types import SimpleNamespace

import pytest

from tandem.functions import storage
from tandem.llm import common


def test_hot_and_salted_joins_equal_plain_ones(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(-1, "alone"), (-2, None)], "i long, k string").repartition(7)
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)] + [("unused", 9)], "k string, v long")
    rows = lambda df: sorted(map(repr, df.select("i", "k", "v").collect()))
    want = rows(big.join(small, "k", "left"))
    for share in (2, 100, 1000):
        assert rows(common.hot_join(big, small, "k", share)) == want
    assert rows(common.salted_join(big, small, "k", ["i"])) == rows(big.join(small, "k"))
    assert common.salted_join(big, small, "k", ["i"], "left_semi").count() == 3000
    none = big.limit(0)
    assert common.hot_join(none, small, "k").count() == 0 and common.salted_join(none, small, "k", ["i"]).count() == 0


@pytest.mark.parametrize("folder", [common.shared_dir, storage.shared_folder])
def test_a_cluster_needs_a_shared_folder(folder):
    session = lambda master, root: SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda key, default: root))
    assert folder(session("spark://host:7077", "s3://shared/")).startswith("s3://shared/")
    assert folder(session("local[4]", None))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            folder(session(master, None))
