"""Quality classifier by co-training.

Two views of a document: its text content (hashed words, and how kinds of
characters follow each other) and its page metadata (language, source, length).
Each view has its own logistic classifier.  In rounds, each calibrated classifier
hands every document of the corpus that it is sure of to the other as a
pseudo-label.  In the end the two calibrated views are combined, with weights
fitted on held-out labels, and score every document.

* **Labels.**  The fit uses a bounded sample of labelled documents, at most
  ``LABELLED``, chosen by a hash of the doc_id and weighted back to the class
  shares of all labels.
* **Pseudo-labels** come from all documents but those of the labelled sample, in one pass a
  round, and are summed where they arise.  The metadata view has few different feature vectors,
  so its pseudo-labels are counts of these: nothing is lost.  For the content view each pass sums
  the exact gradient of the loss over all documents that the metadata view handed over, and a
  bound on its curvature.  Together they are a quadratic that lies above that loss everywhere and touches
  it at the present weights; the fit minimises the labels' loss plus this quadratic, so that each round
  lowers the loss over labels and all pseudo-labels (majorise and minimise).  Pseudo-labels weigh
  ``PSEUDO`` times the labels.

Scoring is one distributed pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import text_batches

#: Labelled documents in the fit, half of each class where there are enough.
LABELLED = 2_400
ROUNDS = 4
#: Calibrated probability from which a pseudo-label is handed over.
SURE = 0.97
#: Weight of all pseudo-labels to that of the labels.
PSEUDO = 0.5
#: Units of a feature in fixed point.
FIXED = 1 << 24
WORD_BUCKETS = 1024
_LETTER, _UPPER, _DIGIT, _BLANK, _BREAK, _WIDE = range(6)


def _kinds() -> np.ndarray:
    """Character kinds of bytes: letters, capitals, digits, blanks, line ends, non-ASCII, and each mark by itself."""
    kinds, mark = np.zeros(256, np.int64), _WIDE + 1
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kinds[b] = _WIDE
        elif c.islower():
            kinds[b] = _LETTER
        elif c.isupper():
            kinds[b] = _UPPER
        elif c.isdigit():
            kinds[b] = _DIGIT
        elif c == "\n":
            kinds[b] = _BREAK
        elif c.isspace() or b < 32 or b == 127:
            kinds[b] = _BLANK
        else:
            kinds[b] = mark
            mark += 1
    return kinds


KIND = _kinds()
KINDS = int(KIND.max()) + 1
SHAPES = 4
CONTENT = WORD_BUCKETS + KINDS * KINDS + SHAPES
META = 16 + 128 + 8


class _Content:
    """Sparse content features of a slice of texts: positions, values and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = W.scan(data, offsets, W.NOT_SPACE, True)
        self.rows = len(offsets) - 1
        count = np.maximum(words.count, 1)
        row = words.row
        kind = KIND[data]
        owner = np.repeat(np.arange(self.rows), np.diff(offsets))
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.empty(0, np.int64)
        length = np.maximum(np.diff(offsets), 1)
        again = np.zeros(len(row), bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((words.hash, row))
        new = np.ones(len(row), bool)
        new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
        kinds = np.bincount(row[order][new], minlength=self.rows)
        shape = np.stack([np.bincount(row, again, minlength=self.rows) / count, kinds / count, np.log1p(words.count) / 10, (words.count == 0).astype(float)], 1)
        self.at = np.concatenate([(words.hash % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS + kind[inner] * KINDS + kind[inner + 1]])
        self.row = np.concatenate([row, owner[inner]])
        self.value = np.concatenate([4.0 / count[row], 4.0 / length[owner[inner]]])
        self.shape = shape

    def dense(self) -> np.ndarray:
        flat = np.bincount(self.row * CONTENT + self.at, self.value, minlength=self.rows * CONTENT)
        out = flat.reshape(self.rows, CONTENT)
        out[:, -SHAPES:] = self.shape
        return out.astype(np.float32)

    def slopes(self, weights: np.ndarray, label: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Of the chosen rows, in fixed point: the sum of the loss' gradients, and of a bound on its curvature.

        The curvature of a row's loss is at most a quarter of ``x x'``, which lies below the diagonal of ``|x| * sum(|x|) / 4``.
        """
        off = np.where(chosen, np.rint((_sigmoid(self.score(weights[:-1]) + weights[-1]) - label) * 2.0**20) / 2.0**20, 0.0)
        total = 1 + np.bincount(self.row, self.value, minlength=self.rows) + np.abs(self.shape).sum(1)
        bend = np.where(chosen, np.rint(total * 2.0**20) / 2.0**22, 0.0)
        out = np.zeros((2, CONTENT + 1))
        for k, by in enumerate((off, bend)):  # sums of whole numbers, exact in any order
            out[k, :CONTENT] = np.bincount(self.at, np.rint(self.value * by[self.row] * FIXED), minlength=CONTENT)
            out[k, CONTENT - SHAPES : CONTENT] += np.rint((np.abs(self.shape) if k else self.shape) * by[:, None] * FIXED).sum(0)
            out[k, CONTENT] = np.rint(by * FIXED).sum()
        return out.astype(np.int64)

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.at], minlength=self.rows) + self.shape @ weights[-SHAPES:]


def _metadata(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    out = np.zeros((len(lang), META), np.float32)
    for column, base, size in ((lang, 0, 16), (source, 16, 128)):
        data, offsets = W.utf8(column.cast(pa.string()))
        hashes = W.scan(data, offsets, np.ones(256, bool), False)
        place = np.full(len(lang), base)  # null and empty share a place
        place[hashes.row] = base + 1 + (hashes.hash % np.uint64(size - 1)).astype(np.int64)
        out[np.arange(len(lang)), place] = 1
    n = np.array([x if x is not None and x >= 0 else -1 for x in n_chars.to_pylist()], float)
    step = np.clip(np.log10(np.maximum(n, 0) + 1), 0, 6.99)
    out[np.arange(len(n)), 144 + step.astype(int)] = 1
    out[n < 0, 144:] = 0
    return out


_INPUT = ["doc_id", "text", "lang", "source", "n_chars"]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Content, np.ndarray]]:
    for batch in W.resliced(batches, 1 << 20):
        yield batch, _Content(*W.utf8(batch.column(1))), _metadata(batch.column(2), batch.column(3), batch.column(4))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, content, meta in _slices(batches):
        x = np.concatenate([content.dense(), meta], 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 200, more: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression (accelerated gradient steps).

    ``more`` adds a quadratic: its centre, its gradient there and its diagonal.
    """
    centre, slope, bend = more or (0.0, 0.0, 0.0)
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    weight = weight / weight.sum()
    size = 0.25 * float((weight[:, None] * x * x).sum()) + ridge + float(np.max(bend))
    w = np.zeros(x.shape[1]) if more is None else centre.copy()
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = x.T @ (weight * (_sigmoid(x @ v) - y)) + ridge * np.append(v[:-1], 0) + slope + bend * (v - centre)
        new = v - g / size
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and intercept that turn a view's margin into a log-odds."""
    s = max(float(np.std(z)), 1e-6)
    w = fit_logistic((z / s)[:, None], y, weight, 1e-3, 500)
    return max(float(w[0]) / s, 0.0), float(w[1])


@dataclass
class Model:
    """Weights of the two views, their calibrations, and the weights of the combination."""

    content: np.ndarray
    metadata: np.ndarray
    calibration: list[tuple[float, float]]
    combined: np.ndarray
    pseudo_labels: int


def margins(model: Model, content: _Content, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return content.score(model.content[:-1]) + model.content[-1], meta @ model.metadata[:-1] + model.metadata[-1]


def _odds(model: Model, content: _Content, meta: np.ndarray) -> list[np.ndarray]:
    """Calibrated log-odds of the two views."""
    return [np.clip(s * z + b, -8, 8) for (s, b), z in zip(model.calibration, margins(model, content, meta), strict=True)]


_HANDED = "view int, place bigint, label int, n bigint, x binary"


def _hand_over(shared):
    """What each view is sure of, for the other: counts by metadata vector; gradient and curvature of the content view's loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, labelled = shared.value
        counts: dict[tuple[int, int], int] = {}
        sums = np.zeros((2, CONTENT + 1), np.int64)  # in fixed point, so that the order of the sum doesn't matter
        number = 0
        for batch, content, meta in _slices(batches):
            by_content, by_meta = (_sigmoid(z) for z in _odds(model, content, meta))
            # labelled documents have their say already, and a quarter of them judges the views
            free = ~np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), labelled) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            place = _meta_place(meta)
            for label, from_content in ((1, by_content >= SURE), (0, by_content <= 1 - SURE)):
                for p, n in zip(*(x.tolist() for x in np.unique(place[from_content & free], return_counts=True)), strict=True):
                    counts[p, label] = counts.get((p, label), 0) + n
            sure = ((by_meta >= SURE) | (by_meta <= 1 - SURE)) & free
            if sure.any():
                sums += content.slopes(model.content, (by_meta >= 0.5).astype(float), sure)
                number += int(sure.sum())
        rows = [(1, p, label, n, None) for (p, label), n in counts.items()]
        rows += [(0, k, 0, number, sums[k].tobytes()) for k in (0, 1) if number]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["view", "place", "label", "n", "x"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one or more (view, place, label), vectors read one batch at a time."""
    total: dict[tuple, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            have = total.setdefault((row["view"], row["place"], row["label"]), [0, None])
            have[0] += row["n"]
            if row["x"] is not None:
                x = np.frombuffer(row["x"], np.int64)
                have[1] = x if have[1] is None else have[1] + x
    if total:
        cols = [pa.array([k[i] for k in total], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([n for n, _ in total.values()], pa.int64()), pa.array([None if x is None else x.tobytes() for _, x in total.values()], pa.binary())], ["view", "place", "label", "n", "x"])


def _meta_place(meta: np.ndarray) -> np.ndarray:
    """One number for each metadata vector: its language, source and length places."""
    length = meta[:, 144:]
    return meta[:, :16].argmax(1) * 1024 * 16 + meta[:, 16:144].argmax(1) * 16 + np.where(length.any(1), length.argmax(1), 15)


def _meta_vector(place: int) -> np.ndarray:
    out = np.zeros(META, np.float32)
    out[place // (1024 * 16)] = 1
    out[16 + place // 16 % 1024] = 1
    if place % 16 < 15:
        out[144 + place % 16] = 1
    return out


@dataclass
class Handed:
    """Pseudo-labels: for the content view mean gradient, mean bound on the curvature and number of documents; for the metadata view rows, labels and documents of each."""

    slope: np.ndarray
    bend: np.ndarray
    number: int
    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    @property
    def documents(self) -> int:
        return self.number + int(self.n.sum())


def handed_over(docs: DataFrame, model: Model, labelled: np.ndarray) -> Handed:
    """What the two views are sure of, over all documents but the ``labelled`` (at most LABELLED ids).

    Two vectors and one count for each different metadata vector (16 languages, 128 sources
    and 8 lengths by hash) come to the driver, whatever the corpus holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, labelled))
    sums = docs.mapInArrow(_hand_over(shared), _HANDED).repartition(8, "view", "place", "label").mapInArrow(_add_up, _HANDED)
    rows = sorted(sums.collect(), key=lambda r: (r["view"], r["place"], r["label"]))
    first = [(np.frombuffer(bytes(r["x"]), np.int64) / (r["n"] * float(FIXED)), r["n"]) for r in rows if r["view"] == 0]
    mine = [r for r in rows if r["view"] == 1]
    x = np.array([_meta_vector(r["place"]) for r in mine], np.float32).reshape(len(mine), META)
    none = np.zeros(CONTENT + 1)
    return Handed(first[0][0] if first else none, first[1][0] if first else none, first[0][1] if first else 0, x, np.array([r["label"] for r in mine], float), np.array([r["n"] for r in mine], float))


def fit_views(x: np.ndarray, label: np.ndarray, weight: np.ndarray, handed: Handed | None, before: Model | None = None) -> Model:
    """Fit both views on labelled rows and what was handed over; calibrate and combine them on a held-out quarter of the labels.

    ``before`` is the model at which ``handed`` was measured.
    """
    held = np.arange(len(label)) % 4 == 0
    own = ~held
    prior = float((weight * label).sum() / weight.sum()) if len(label) else 0.5
    if len(set(label[own].tolist())) < 2 or len(set(label[held].tolist())) < 2:
        odds = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return Model(np.zeros(CONTENT + 1), np.zeros(META + 1), [(0.0, odds), (0.0, odds)], np.array([0.0, 0.0, odds]), 0)
    weights, calibrations, odds = [], [], []
    for k, view in enumerate((x[:, :CONTENT], x[:, CONTENT:])):
        rows, y, w, more = view[own], label[own].astype(float), weight[own], None
        if handed is not None and k == 0 and handed.number:
            more = (before.content, PSEUDO * handed.slope, PSEUDO * handed.bend)
        if handed is not None and k == 1 and len(handed.n):
            rows, y = np.concatenate([rows, handed.x]), np.concatenate([y, handed.y])
            w = np.concatenate([w / w.sum(), PSEUDO * handed.n / handed.n.sum()])
        w = fit_logistic(rows, y, w, 1e-5, more=more)
        margin = view[held] @ w[:-1] + w[-1]
        weights.append(w)
        calibrations.append(_calibrate(margin, label[held].astype(float), weight[held]))
        odds.append(np.clip(calibrations[k][0] * margin + calibrations[k][1], -8, 8))
    combined = fit_logistic(np.stack(odds, 1), label[held].astype(float), weight[held], 1e-3, 800)
    combined[:2] = np.maximum(combined[:2], 0)
    return Model(weights[0], weights[1], calibrations, combined, handed.documents if handed else 0)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint"))


def co_train(docs: DataFrame, labels: DataFrame, column: str = "quality", rounds: int = ROUNDS) -> Model:
    """The model of ``rounds`` exchanges; ends earlier when neither pseudo-labels nor weights change."""
    ids, x, label, weight = sample_of(docs, labels, column)
    model = fit_views(x, label, weight, None)
    for _ in range(rounds if model.content.any() or model.metadata.any() else 0):
        new = fit_views(x, label, weight, handed_over(_rows(docs), model, ids), model)
        still = new.pseudo_labels == model.pseudo_labels and np.abs(new.content - model.content).max() < 1e-3
        model = new
        if still:
            break
    return model


def sample_of(docs: DataFrame, labels: DataFrame, column: str, labelled: int = LABELLED) -> tuple[np.ndarray, ...]:
    """Ids, features, labels and weights of the bounded sample of labelled documents.

    Documents with both labels are left out.
    """
    text_batches(docs)
    known = labels.select(F.col("doc_id").cast("bigint"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = reduce(DataFrame.unionAll, [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(labelled // 2) for v in (0, 1)])
    # at most LABELLED rows of two numbers
    rows = docs.select(*(F.col(c) for c in _INPUT)).join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id")).select(*_INPUT, "label")
    got = rows.mapInArrow(_features, "doc_id bigint, label int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    # rows that repeat a doc_id count once
    got = [r for i, r in enumerate(got) if not i or r["doc_id"] != got[i - 1]["doc_id"]]
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), CONTENT + META)
    label = np.array([r["label"] for r in got], int)
    ids = np.array([r["doc_id"] for r in got], np.int64)
    turn = np.random.default_rng(1).permutation(len(got))
    ids, x, label = ids[turn], x[turn], label[turn]
    weight = np.ones(len(label))
    for v, n in shares.items():
        if (label == v).any():
            weight[label == v] = n / (label == v).sum()
    return ids, x, label, weight


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch, content, meta in _slices(batches):
            odds = _odds(m, content, meta)
            both = _sigmoid(odds[0] * m.combined[0] + odds[1] * m.combined[1] + m.combined[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(v, np.float64)) for v in (_sigmoid(odds[0]), _sigmoid(odds[1]), both))], ["doc_id", "content_score", "metadata_score", "score"])

    return run


def score(docs: DataFrame, model: Model, keep_from: float = 0.5) -> DataFrame:
    """``doc_id, content_score, metadata_score, score, kept`` of every row.

    Null or empty texts score by their metadata and the empty text's features;
    null metadata has features of its own; repeated rows score alike; an empty
    table gives no rows.
    """
    text_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _rows(docs).mapInArrow(_score(shared), "doc_id bigint, content_score double, metadata_score double, score double").withColumn("kept", F.col("score") >= keep_from)


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Train on ``labels`` (doc_id and a 0/1 column) and score every row of ``docs``.

    Without labels of both classes every row gets the prior as its score.
    Documents labelled both ways are left out of the fit; labelled documents are
    scored like all others, but never handed over.  Very long texts are read
    whole.
    """
    return score(docs, co_train(docs, labels, column))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
