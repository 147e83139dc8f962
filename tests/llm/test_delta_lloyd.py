"""Delta Lloyd against plain Lloyd over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import delta_lloyd as D

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, clusters, rounds, size, scale):
    kept = [(i, tuple(max(-(1 << 25), min(1 << 25, math.floor(scale * x))) for x in v)) for i, v, _ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)][:clusters]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)) if n in groups else c for n, c in enumerate(centroids)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def rows_of(seed, n, size):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i * 3, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)], 1) for i in range(n)]
    rows += [(i * 3 + 1, [0.5] * size, 2) for i in range(40)]  # one vector many times
    rows += [(5, None, 1), (8, [1.0] * (size - 1), 1), (11, [], 1), (14, [None, *[0.1] * (size - 1)], 1), (17, [float("nan"), *[0.1] * (size - 1)], 1), (20, [float("inf"), *[0.1] * (size - 1)], 1)]
    return rows + [(None, [0.25] * size, None), (0, [0.3] * size, 1)]


@pytest.mark.parametrize("seed,clusters,rounds,size,block", [(1, 6, 3, 4, 8 << 20), (2, 7, 8, 3, 48), (3, 300, 2, 2, 8 << 20), (4, 5, 0, 4, 8 << 20), (5, 1, 3, 3, 8 << 20)])
def test_equals_plain_lloyd(spark, monkeypatch, seed, clusters, rounds, size, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rows = rows_of(seed, 150, size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("owner", F.lit("clash")).withColumn("v", F.lit(1))
    members, centroids = D.cluster(df, clusters, rounds, size)
    got = sorted((str(r.vec_id), r.cluster, r.distance) for r in members.collect())
    assert (got, centroids) == plain(rows, clusters, rounds, size, 64)


def test_empty_table_and_large_components(spark):
    members, centroids = D.cluster(spark.createDataFrame([], SCHEMA))
    assert (members.count(), centroids) == (0, [])
    assert D.cluster(spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], SCHEMA))[0].count() == 0
    rows = [(i, [x, -x / 3, 1.0], 1) for i, x in enumerate([1e300, -1e300, 400_000.3, 399_999.9, -5e5, 3.0])]
    members, centroids = D.cluster(spark.createDataFrame(rows, SCHEMA), 3, 3, 3)
    assert (sorted((str(r.vec_id), r.cluster, r.distance) for r in members.collect()), centroids) == plain(rows, 3, 3, 3, 64)


def test_only_the_changed_centroids_and_the_moved_vectors_are_compared(monkeypatch):
    import pyarrow as pa

    seen = []
    whole = D.squared_distances
    monkeypatch.setattr(D, "squared_distances", lambda x, c: seen.append((len(x), len(c))) or whole(x, c))
    centroids = np.array([[0, 0], [10, 10], [20, 20], [30, 30]])
    v = np.array([[1, 1], [11, 11], [12, 12], [19, 19], [31, 31]], np.int32)
    owner = np.array([0, 1, 1, 2, 3], np.int32)
    d = whole(v, centroids)[np.arange(5), owner]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(list(map(list, v.tolist())), pa.list_(pa.int32())), pa.array(owner), pa.array(d), pa.array(owner)], ["vec_id", "v", "owner", "distance", "was"])
    moved = centroids.copy()
    moved[1] = [18, 18]
    changed = np.array([False, True, False, False])
    (out,) = D._compare(np.arange(4, dtype=np.int32), moved, changed, True, np.array([1], np.int32))(iter([batch]))
    assert seen == [(5, 1), (2, 3)]
    assert out.column("owner").to_pylist() == whole(v, moved).argmin(1).tolist() and out.column("was").to_pylist() == owner.tolist()
