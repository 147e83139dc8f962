"""The co-trained classifier by held-out accuracy, and its edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import quality_classifier as Q

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n, seed=1):
    rng = random.Random(seed)
    good = ["the", "quiet", "river", "runs", "past", "old", "stone", "houses", "and", "people"]
    rows, labels = [], []
    for i in range(n):
        fine = rng.random() < 0.6
        text = " ".join(rng.choice(good) for _ in range(40)) + "." if fine else " ".join(rng.choice(good).upper() + "!!" for _ in range(40))
        source = rng.choice(["news", "books"]) if fine == (rng.random() < 0.8) else "spam"
        rows.append((i, text, "en", source, len(text)))
        labels.append((i, int(fine)))
    return rows, labels


def test_held_out_accuracy_and_exchange(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels[:200], "doc_id bigint, quality int")
    model = Q.co_train(docs, known)
    assert model.pseudo_labels > 0
    assert model.combined[0] > model.combined[1] >= 0  # the surer view counts more
    truth = dict(labels)
    scored = Q.score(docs, model).collect()
    held = [r for r in scored if r.doc_id >= 200]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in held]) > 0.97
    alone = np.mean([(r.metadata_score >= 0.5) == bool(truth[r.doc_id]) for r in held])
    assert 0.6 < alone < 0.97
    again = Q.co_train(docs.repartition(3), known)
    assert (again.content == model.content).all() and (again.combined == model.combined).all()


def test_what_is_handed_over_equals_brute_force(spark):
    """All confident documents of both views but the labelled ones, counted and summed one by one."""
    import pyarrow as pa

    rows, labels = corpus(400, 5)
    rows += [(None, "the quiet river " * 20, "de", None, None), (900, None, "en", "spam", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids, x, label, weight = Q.sample_of(docs, spark.createDataFrame(labels[:150], "doc_id bigint, quality int"), "quality")
    assert set(ids.tolist()) == set(range(150))
    model = Q.fit_views(x, label, weight, None)
    model.calibration[1] = tuple(5 * v for v in model.calibration[1])  # surer than its labels make it
    slope, bend, number, counts = np.zeros(Q.CONTENT + 1), np.zeros(Q.CONTENT + 1), 0, {}
    for i, text, lang, source, n in rows:
        if i is not None and i < 150:
            continue
        batch = pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text]), pa.array([lang]), pa.array([source]), pa.array([n])], Q._INPUT)
        ((_, content, meta),) = Q._slices([batch])
        a, b = (float(Q._sigmoid(z)[0]) for z in Q._odds(model, content, meta))
        for value, sure, other in ((1, a, b), (0, 1 - a, 1 - b)):
            if sure >= Q.SURE:
                key = (value, meta.tobytes())
                counts[key] = counts.get(key, 0) + 1
            if other >= Q.SURE:
                v = np.append(content.dense()[0].astype(float), 1)
                slope += (Q._sigmoid(v @ model.content) - value) * v
                bend += np.abs(v) * np.abs(v).sum() / 4
                number += 1
    handed = Q.handed_over(Q._rows(docs.repartition(4)), model, ids)
    assert counts and {(int(y), v.tobytes()): int(n) for v, y, n in zip(handed.x, handed.y, handed.n)} == counts
    assert handed.number == number > 0
    assert np.abs(handed.slope - slope / number).max() < 1e-4 and np.abs(handed.bend - bend / number).max() < 1e-3
    assert handed.documents == number + sum(counts.values())


def test_each_round_lowers_the_loss_over_labels_and_pseudo_labels():
    rng = np.random.default_rng(3)
    x, y = rng.random((60, 5)), (rng.random(60) < 0.5).astype(float)
    more, t = rng.random((400, 5)), (rng.random(400) < 0.7).astype(float)
    one = np.append
    loss = lambda w, x, y: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * (x @ w[:-1] + w[-1])))))
    w = Q.fit_logistic(x, y, np.ones(60), 1e-5)
    ones = np.concatenate([more, np.ones((400, 1))], 1)
    losses = []
    for _ in range(40):
        losses.append(loss(w, x, y) + Q.PSEUDO * loss(w, more, t))
        slope = ones.T @ (Q._sigmoid(ones @ w) - t) / 400
        bend = (ones * ones.sum(1, keepdims=True)).mean(0) / 4
        w = Q.fit_logistic(x, y, np.ones(60), 1e-5, 2000, more=(w, Q.PSEUDO * slope, Q.PSEUDO * bend))
    assert all(b <= a + 1e-6 for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0]
    both = Q.fit_logistic(np.concatenate([x, more]), one(y, t), one(np.ones(60) / 60, Q.PSEUDO * np.ones(400) / 400), 1e-5, 5000)
    assert losses[-1] - (loss(both, x, y) + Q.PSEUDO * loss(both, more, t)) < 1e-3


def test_the_exchange_teaches_the_content_view_words_without_labels(spark):
    """Half of the corpus has words that no labelled document has; its sources tell its quality."""
    rng = random.Random(7)
    words = {(half, fine): [f"{half}{fine}w{i}" for i in range(12)] for half in "ab" for fine in (0, 1)}
    rows, truth = [], {}
    for i in range(1200):
        half, fine = ("a", "b")[i >= 400], int(rng.random() < 0.5)
        truth[i] = fine
        shared = [f"common{j}" for j in range(12)]
        text = " ".join(rng.choice(words[half, fine] if rng.random() < 0.4 else shared) for _ in range(40))
        sure = rng.random() < 0.8  # others come from a source that says nothing
        rows.append((i, text, "en", ("good" if fine else "bad") if sure else "any", 200))
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(i, truth[i]) for i in range(400)], "doc_id bigint, quality int")

    def log_loss(model):
        held = [r for r in Q.score(docs, model).collect() if r.doc_id >= 400 and rows[r.doc_id][3] == "any"]
        p = np.clip([r.score for r in held], 1e-6, 1 - 1e-6)
        y = np.array([truth[r.doc_id] for r in held])
        content = np.mean([(r.content_score >= 0.5) == bool(truth[r.doc_id]) for r in held])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), content

    (without, blind), (with_, taught) = log_loss(Q.co_train(docs, known, rounds=0)), log_loss(Q.co_train(docs, known))
    assert taught > 0.9 > blind + 0.15
    assert with_ < without - 0.2


def test_documents_labelled_both_ways_and_repeated(spark):
    rows, labels = corpus(60, 3)
    docs = spark.createDataFrame(rows + rows[:10], SCHEMA)
    both = spark.createDataFrame([*labels, (3, 1 - labels[3][1]), labels[4], (None, 1), (5000, 1)], "doc_id bigint, quality int")
    _, x, label, _ = Q.sample_of(docs, both, "quality")
    assert len(x) == 59 and label.sum() == sum(y for i, y in labels if i != 3)


def test_dense_and_sparse_scores_agree():
    from weftgraph.llm import words as W
    import pyarrow as pa

    data, offsets = W.utf8(pa.array(["a b b", None, "", "Ünïcode!! #", "x" * 5000]))
    content = Q._Content(data, offsets)
    weights = np.random.default_rng(1).normal(size=Q.CONTENT)
    assert np.allclose(content.dense() @ weights, content.score(weights), atol=1e-4)


def test_nulls_repeats_and_empty_tables(spark):
    rows, labels = corpus(200, 2)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    odd = [(1000, None, None, None, None), (None, "", "", "", -5), (7, rows[7][1], "en", "news", 10), (1001, "word " * 30000, "en", "news", 150000)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("label", F.lit("clash")).withColumn("id", F.lit(0))
    out = Q.classify(docs, known)
    got = out.collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(docs.limit(0), known).count() == 0
    one = Q.classify(docs, known.filter("quality = 1")).collect()
    assert len({round(r.score, 6) for r in one}) == 1
    none = Q.classify(docs, known.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
