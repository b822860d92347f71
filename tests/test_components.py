import random

import pytest

from shapeloom.operators import components
from shapeloom.operators.components import connected_components
from shapeloom.operators.staging import shared_dir, written, discard


def plain(edges):
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    up = {x: x for e in real for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in real:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in up)


def test_hubs_paths_and_odd_rows(spark, monkeypatch):
    """A star around a large id, long paths, random parts, nulls, loops and repeats, with few and with many hubs."""
    rng = random.Random(5)
    star = [(9_000, k) for k in range(3_000, 5_000)]
    path = [(i, i + 1) for i in range(300)]
    mixed = [(rng.randrange(10_000, 10_800), rng.randrange(10_000, 10_800)) for _ in range(600)]
    edges = star + path + mixed + [(5, 5), (None, 2), (2, None), (50_000, 50_000)] + path[:9]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    for hubs in (components.HUBS, 8):
        monkeypatch.setattr(components, "HUBS", hubs)
        monkeypatch.setattr(components, "SLICE", 64)
        assert sorted(map(tuple, connected_components(frame, "a", "b").collect())) == plain(edges)
    assert connected_components(frame.where("false"), "a", "b").collect() == []


def test_written_tables_go_when_discarded(spark):
    table = written(spark.range(5), "probe")
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert files.exists(path) and table.count() == 5
    discard(table)
    discard(table)
    assert not files.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster())
