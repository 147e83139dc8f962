"""Centroid clustering: Lloyd's rounds that touch only what changed.

State between rounds, both tables in the shared folder: the vectors with their owner and
the distance to it, and the sums and counts of all clusters.  A round

1. compares every vector with the centroids that changed, and only those whose own
   centroid moved with the others too: to any other vector an unchanged
   centroid is as near as before, and it wasn't the nearest then (ties go to the smaller number);
2. aggregates signed transfers: a vector that changed hands is subtracted from its old cluster's
   sums and added to the new one's, in the task first, so that a row per cluster and
   component leaves a task, however many vectors moved;
3. takes the floor of sum / count as the new centroids.

Distances are float64 matrix products where every term stays below 2**53 (checked for each
batch), and 64-bit integers beyond.  Centroids reach the tasks in blocks of at most
``BLOCK_BYTES``, one pass through Python each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from . import words as W
from .shared import written

#: Centroids that go to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Most components of all centroids, which the driver holds.
MOST_CELLS = 16 << 20
#: Components beyond this count as this: 64 squared differences still fit a long.
BOUND = 1 << 25
#: Vectors that are compared at once.
ROWS = 4096
_STATE = "vec_id bigint, v array<int>, owner int, distance bigint, was int"


def integer_vectors(vectors: DataFrame, scale: int, size: int | None) -> DataFrame:
    """``floor(scale * x)`` of the vectors that have ``size`` components, all of them finite: adds ``v`` array<int>."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(x.isNotNull() & finite if size is None else (F.size(x) == size) & finite)
    bound = F.lit(float(BOUND))
    return kept.withColumn("v", F.transform(x, lambda c: F.greatest(-bound, F.least(bound, F.floor(c * float(scale)).cast("double"))).cast("int")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return W.split_lists(column)[0].reshape(-1, size)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):  # no array of rows x centroids x components
        out += (x[:, k, None] - c[None, :, k]) ** 2
    return out


def _nearer(x: np.ndarray, rows: np.ndarray, numbers: np.ndarray, centroids: np.ndarray, owner: np.ndarray, best: np.ndarray) -> None:
    """Give ``rows`` the nearest of the centroids where that beats what they have; ``numbers`` ascend."""
    if not len(numbers):
        return
    for lo in range(0, len(rows), ROWS):
        at = rows[lo : lo + ROWS]
        d = squared_distances(x[at], centroids)
        first = d.argmin(1)
        d, n = d[np.arange(len(at)), first], numbers[first]
        win = (d < best[at]) | ((d == best[at]) & (n < owner[at]))
        owner[at[win]], best[at[win]] = n[win], d[win]


def _compare(numbers: np.ndarray, centroids: np.ndarray, changed: np.ndarray, opens: bool, changed_all: np.ndarray):
    """One block of centroids; the first block of a round forgets the distance of vectors whose centroid changed."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("v"), size)
            owner, was = batch.column("owner").to_numpy().copy(), batch.column("was").to_numpy()
            best = batch.column("distance").to_numpy().copy()
            if opens:
                was = owner.copy()
            lost = (was < 0) | np.isin(was, changed_all)
            if opens:
                owner[lost], best[lost] = np.iinfo(np.int32).max, np.iinfo(np.int64).max
            everyone = np.arange(len(x))
            _nearer(x, everyone, numbers[changed], centroids[changed], owner, best)
            _nearer(x, everyone[lost], numbers[~changed], centroids[~changed], owner, best)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(owner), pa.array(best), pa.array(was)], ["vec_id", "v", "owner", "distance", "was"])

    return run


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    step = max(1, BLOCK_BYTES // (8 * max(1, centroids.shape[1])))
    for lo in range(0, len(centroids), step):
        part = slice(lo, lo + step)
        state = state.mapInArrow(_compare(np.arange(len(centroids), dtype=np.int32)[part], centroids[part], changed[part], lo == 0, np.flatnonzero(changed).astype(np.int32)), _STATE)
    return written(state)


def _transfers(size: int):
    """Signed sums and counts (component -1) of the vectors of a task that changed hands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("v"), size).astype(np.int64)
            for column, sign in (("owner", 1), ("was", -1)):
                clusters, of = np.unique(batch.column(column).to_numpy(), return_inverse=True)
                order = np.argsort(of, kind="stable")
                starts = np.searchsorted(of[order], np.arange(len(clusters)))
                sums = np.add.reduceat(x[order], starts) if len(clusters) else x
                counts = np.bincount(of, minlength=len(clusters))
                for c, row, n in zip(clusters.tolist(), sums, counts, strict=True):
                    if c >= 0:
                        total = found.setdefault(c, np.zeros(size + 1, np.int64))
                        total += sign * np.concatenate([[n], row])
        for c, total in found.items():
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), c, np.int32)), pa.array((there - 1).astype(np.int32)), pa.array(total[there])], ["cluster", "component", "total"])

    return run


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1:") -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Delta Lloyd over integer vectors: ``(vec_id, cluster, distance)``, and the final centroids.

    Input: ``vec_id`` bigint and ``embedding``; other columns are ignored.  Vectors with exactly
    ``size`` components, none null or not finite, take part as ``floor(scale * x)``.  Centroids
    start as the vectors with the smallest sha256 of ``seed`` and their id.  Each of ``rounds``
    rounds assigns every vector (squared distance; ties: the smaller number) and replaces each non-empty
    centroid by the floor of its vectors' mean; then vectors are assigned once more.

    Defined cases: other vectors have no row; a null ``vec_id`` is assigned, but starts no
    cluster; rows that repeat a ``vec_id`` each count, and of equal hashes the smaller vector
    starts first; fewer vectors than clusters make fewer clusters, and equal centroids leave the larger
    number empty; an empty table gives no rows and no centroids; scaled components beyond
    2**25 count as 2**25.
    """
    if clusters * size > MOST_CELLS:
        raise ValueError(f"{clusters} centroids of {size} components are more than the driver should hold")
    state = written(integer_vectors(vectors.select(F.col("vec_id").cast("bigint"), "embedding"), scale, size).select("vec_id", "v", F.lit(-1).alias("owner"), F.lit((1 << 63) - 1).alias("distance"), F.lit(-1).alias("was")))
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    start = state.filter("vec_id is not null").orderBy(digest, "v").limit(clusters).select("v").collect()
    if not start:
        return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), []
    centroids = np.array([r.v for r in start], np.int64)
    changed, sums = np.ones(len(centroids), bool), None
    for _ in range(rounds):
        state = _assigned(state, centroids, changed)
        moved = state.filter("owner <> was").select("v", "owner", "was").mapInArrow(_transfers(size), "cluster int, component int, total bigint")
        sums = written((moved if sums is None else sums.unionAll(moved)).groupBy("cluster", "component").agg(F.sum("total").alias("total")))
        cells = {(r.cluster, r.component): r.total for r in sums.collect()}
        # Python's // is the floor, for negative sums too
        new = np.array([[cells.get((c, k), 0) // cells[c, -1] for k in range(size)] if cells.get((c, -1)) else centroids[c].tolist() for c in range(len(centroids))], np.int64)
        changed = (new != centroids).any(1)
        centroids = new
        if not changed.any():
            break
    if changed.any():
        state = _assigned(state, centroids, changed)
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), [tuple(map(int, c)) for c in centroids]


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    members, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = {r.cluster: int(r.total) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(c, totals.get(c, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    fields = [("cluster", IntegerType()), ("cluster_inertia", LongType()), ("inertia", LongType()), ("centroid_sha256", StringType())]
    # a row per centroid
    return members.join(F.broadcast(spark.createDataFrame(rows, StructType([StructField(*f) for f in fields]))), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int, last: bool) -> str:
    """Assignment r, and unless it is the last the centroids that follow from it."""
    sql = f"""
a{r} AS MATERIALIZED (SELECT i, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT i, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept CROSS JOIN c{r}) GROUP BY i, vec_id, v),"""
    if not last:
        sql += f"""
m{r} AS (SELECT c, list(x ORDER BY k) AS w FROM (SELECT c, k, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS k FROM a{r}) GROUP BY c, k)) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c)),"""
    return sql


OP11_SQL = f"""
WITH fine AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(e, lambda x: floor(64 * x)::BIGINT) AS v FROM fine WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS c, v AS w FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16),
{"".join(_round_sql(r, r == 3) for r in range(4))}
t AS (SELECT c, sum(d)::BIGINT AS n FROM a3 GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, n AS cluster_inertia, (SELECT sum(n) FROM t)::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a3 JOIN t USING (c) JOIN c3 USING (c)
"""
