"""Hard-negative mining: blocks of anchors against all rows by matrix products.

Plan
----
Anchors go out in blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES``, broadcast one
after the other; rows stay where they are and pass in blocks of ``ROWS``.  For each
block of anchors

1. one pass keeps, for each anchor, the best ``positives`` rows of its label in every task: a
   matrix product with the rows of that label, of which only scores not below the anchor's
   worst so far are looked at.  The lists of the tasks merge into one by a window (the
   best few of lists of the best few are the best few of all);
2. a second pass keeps, for each anchor and positive, the best ``negatives`` rows of other labels
   in the positive's window of scores, and merges them in the same way.

The driver holds one block and its positives at a time.  Scores are float64 products where
they stay below 2**53 (checked per block), and 64-bit integers beyond.  All pairs of
anchors and rows are scored, which is what the result asks for: the work is
anchors x rows x components, and blocks only bound the memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .delta_lloyd import integer_vectors
from .shared import shared_folder, written

#: A block of anchors: rows, and bytes of their vectors.
BLOCK_ROWS, BLOCK_BYTES = 32_768, 16 << 20
#: Rows and anchors whose scores are computed at once.
ROWS, ANCHORS = 2048, 1024
_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_LEAST = np.iinfo(np.int64).min


def matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors of any lengths as one matrix; what a shorter one lacks is zero."""
    flat, counts = W.split_lists(column)
    x = np.zeros((len(counts), int(counts.max(initial=0))), np.int32)
    x[np.arange(x.shape[1]) < counts[:, None]] = flat
    return x


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all integer rows of a with those of b; the shorter ones' rows end in zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0))
    if width * most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best ``k`` (score, id) of each slot, by score descending, then id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.worst = np.full(slots, _LEAST)  # the k-th best score, once there are k
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.more = 0

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        self.waiting.append((slot, score, id_))
        self.more += len(slot)
        if self.more > max(200_000, len(self.slot)):
            self.merge()

    def merge(self) -> None:
        slot, score, id_ = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.waiting, strict=True))
        order = np.lexsort((id_, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot, "left")
        rank = np.arange(len(slot)) - first
        keep = rank < self.k
        order, full = order[keep], rank[keep] == self.k - 1
        self.slot, self.score, self.id = slot[keep], score[order], id_[order]
        self.worst[self.slot[full]] = self.score[full]
        self.waiting, self.more = [], 0

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self.merge()
        yield pa.RecordBatch.from_arrays([pa.array(self.slot), pa.array(self.score), pa.array(self.id)], ["slot", "score", "id"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            part = batch.slice(lo, ROWS)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"))


def _best_positives(block, k: int):
    """Rows of an anchor's label, other than those of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = block.value
        best = Best(len(ids), k)
        of = {label: np.flatnonzero(labels == label) for label in np.unique(labels).tolist()}
        for other, label, v in _blocks(batches):
            for one in np.unique(label).tolist():
                there = np.flatnonzero(label == one)
                mine = of.get(one, there[:0])
                for lo in range(0, len(mine), ANCHORS):
                    at = mine[lo : lo + ANCHORS]
                    s = scores(x[at], v[there])
                    i, j = np.nonzero((s >= best.worst[at][:, None]) & (ids[at][:, None] != other[there]))
                    best.add(at[i], s[i, j], other[there[j]])
        yield from best.batch()

    return run


def _best_negatives(block, chosen, k: int):
    """Rows of other labels with scores from 4/5 of a positive's to the positive's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = block.value
        slot_anchor, top = chosen.value  # a slot per anchor and positive
        low = -((-4 * top) // 5)  # 80 * top <= 100 * score
        best = Best(len(top), k)
        # slots by place among those of their anchor, so that each place meets a matrix of scores at once
        place = np.arange(len(top)) - np.searchsorted(slot_anchor, slot_anchor, "left")
        for other, label, v in _blocks(batches):
            for lo in range(0, len(ids), ANCHORS):
                s = scores(x[lo : lo + ANCHORS], v)
                s[labels[lo : lo + ANCHORS, None] == label] = _LEAST
                for p in range(int(place.max(initial=-1)) + 1):
                    slots = np.flatnonzero((place == p) & (slot_anchor >= lo) & (slot_anchor < lo + ANCHORS))
                    mine = s[slot_anchor[slots] - lo]
                    i, j = np.nonzero((mine <= top[slots, None]) & (mine >= np.maximum(low, best.worst)[slots, None]))
                    best.add(slots[i], mine[i, j], other[j])
        yield from best.batch()

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The best of all tasks' lists; Spark ranks within the tasks before it shuffles."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, scale: int = 256, relabel: int = 7, labels: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The hardest negatives of each anchor and positive.

    Input: ``vec_id`` bigint, ``label`` int, ``embedding``; other columns are ignored.  Where
    ``vec_id`` is divisible by ``relabel``, the label is the next one modulo ``labels``.  Scores
    are inner products of ``floor(scale * x)``, higher ones first, ties by smaller id.
    Anchors are the rows whose ``vec_id`` is divisible by ``every``; their positives the first
    rows of the same label; a positive's negatives the first rows of other labels with
    ``80 * positive <= 100 * negative <= 100 * positive``.

    Defined cases: rows with a null id, label or vector, or a component that is null or not finite,
    take no part; of vectors of different lengths the shorter counts as ended by zeros; rows
    that repeat a ``vec_id`` each are candidates, never positives of that id, and each is an anchor of
    its own; an anchor without positives, and a positive without negatives (none in the window, or
    a negative score) give no rows; an empty table gives none; scaled components beyond 2**25
    count as 2**25.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.select(F.col("vec_id").cast("bigint").alias("id"), "label", "embedding").filter("id is not null and label is not null"), scale, None)
    label = F.when(F.col("id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("bigint")
    rows = written(rows.select("id", label.alias("label"), "v"))
    anchors = rows.filter(F.col("id") % every == 0)
    n, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // max(1, 4 * width)))
    blocks = -(-n // block_rows)
    # in turn, whatever the ids are; the number is odd, so that the first rows of tasks spread as well
    anchors = written(anchors.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, 2 * blocks - 1))).cast("int")))
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    for number in sorted(r.block for r in anchors.select("block").distinct().collect()):
        for block in _bounded(anchors.filter(F.col("block") == number), block_rows):
            _mine(spark, rows, block, positives, negatives).write.mode("append").parquet(folder)
    if not n:
        return spark.createDataFrame([], _MINED)
    return spark.read.schema(_MINED).parquet(folder)


def _bounded(anchors: DataFrame, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What was dealt to one block, about half as much as it may hold, cut where it is more."""
    table = anchors.select("id", "label", "v").toArrow()
    for lo in range(0, table.num_rows, most):
        part = table.slice(lo, most)
        yield part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"))


def _mine(spark, rows: DataFrame, block: tuple[np.ndarray, ...], positives: int, negatives: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)
    found = _merged(rows.mapInArrow(_best_positives(sent, positives), "slot bigint, score bigint, id bigint"), positives).toArrow()
    anchor, score, positive = (found.column(c).to_numpy() for c in ("slot", "score", "id"))
    order = np.lexsort((positive, -score, anchor))
    anchor, score, positive = anchor[order], score[order], positive[order]
    chosen = spark.sparkContext.broadcast((anchor, score))
    lists = rows.mapInArrow(_best_negatives(sent, chosen, negatives), "slot bigint, score bigint, id bigint")
    slots = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": block[0][anchor], "positive_id": positive, "positive_score": score}))
    return _merged(lists, negatives).join(F.broadcast(slots), "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negative_mining(spark, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH rows_ AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.id AS anchor_id, a.label AS own, r.id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score FROM rows_ a, rows_ r WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n QUALIFY rank <= 5
"""
