"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, every):
    cut = lambda x: max(-(1 << 25), min(1 << 25, math.floor(256 * x)))
    kept = [(i, (n + 1) % 10 if i % 7 == 0 else n, [cut(x) for x in v]) for i, v, n in rows if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, n) for j, n, w in kept)  # noqa: B905
        for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            found = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(found)]
    return sorted(out)


def rows_of(seed, n, size):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(4)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((rng.randrange(-50, 4 * n) if i % 9 else i, [x + rng.gauss(0, 0.2) for x in m], rng.randrange(4)))
    rows += [(i * 10, [0.5] * size, i % 3) for i in range(40)]  # ties
    rows += [(3, None, 1), (10, [1.0] * size, None), (None, [1.0] * size, 1), (20, [None] * size, 1), (30, [float("nan")] * size, 1), (40, [float("-inf")] * size, 1)]
    return rows + [(50, [0.7] * (size - 1), 1), (60, [], 2), (70, [0.4] * (size + 2), 0), (70, [0.4] * (size + 2), 0)]


def mined(df, **settings):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in H.mine_hard_negatives(df, **settings).collect())


@pytest.mark.parametrize("seed,size,block", [(1, 6, 32_768), (2, 3, 7)])
def test_equals_all_pairs(spark, seed, size, block):
    rows = rows_of(seed, 150, size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = mined(df, every=10, block_rows=block)
    assert got == plain(rows, 10) and len(got) > 50


def test_edge_cases(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []
    large = [(100 * i, [x, 3e5, -x], i % 2) for i, x in enumerate([1e300, 4e5, 9e4, -2e5, 1.0, 0.5])]
    assert mined(spark.createDataFrame(large, SCHEMA)) == plain(large, 100)
    # rows of one id don't fill one block
    same = [(100, [1.0, i / 50], 1) for i in range(30)] + [(101, [0.9, 0.1], 2), (102, [1.0, 0.2], 1)]
    assert mined(spark.createDataFrame(same, SCHEMA).repartition(4), block_rows=5) == plain(same, 100)


def test_lists_of_parts_merge_to_the_best(monkeypatch):
    rng = np.random.default_rng(1)
    slot, score, id_ = rng.integers(0, 9, 5000), rng.integers(0, 50, 5000), rng.permutation(5000)
    best = H.Best(9, 4)
    for lo in range(0, 5000, 500):
        best.add(slot[lo : lo + 500], score[lo : lo + 500], id_[lo : lo + 500])
        best.merge()
    (out,) = best.batch()
    got = sorted(zip(*(out.column(c).to_pylist() for c in ("slot", "score", "id")), strict=True), key=lambda r: (r[0], -r[1], r[2]))
    rows = sorted(zip(slot.tolist(), score.tolist(), id_.tolist(), strict=True), key=lambda r: (r[0], -r[1], r[2]))
    assert got == [r for s in range(9) for r in [x for x in rows if x[0] == s][:4]]
