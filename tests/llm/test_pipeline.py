"""The pipeline against a plain Python version, and the queries as registered."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from test_native import measures
from test_pairs_and_windows import jaccard_components, leaks, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def without(text, item, width=10):
    """The text without the runs of words that are inside windows of the item."""
    bench = item.split()
    windows = {tuple(bench[k : k + width]) for k in range(len(bench) - width + 1)}
    found = list(re.finditer("[a-z0-9]+", text))
    w = [m[0] for m in found]
    hit = {j for k in range(len(w) - width + 1) if tuple(w[k : k + width]) in windows for j in range(k, k + width)}
    out, at = "", 0
    for j in sorted(hit):
        if j - 1 not in hit:
            out += text[at : found[j].start()]
        at = found[j].end()
    return out + text[at:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    item = " ".join(rng.choice(vocab) for _ in range(14))
    rows = []
    for i in range(160):
        w = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        if rows and rng.random() < 0.3:
            w = rng.choice(rows)[1].replace("\n", " ").split()
            w[rng.randrange(len(w))] = rng.choice(vocab)
        text = " ".join(w[:30]) + ".\n" + " ".join(w[30:]) + "."
        if rng.random() < 0.2:
            text += "\n" + item
        if rng.random() < 0.2:
            text += "\nhome | news | sport"
        rows.append((i, text, "en", rng.choice(["x", "x", "x", "y", "z", None]), len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "y", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_stages_equal_a_plain_version(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    kept = [(r[0], measures(r[1])[7], *r[2:]) for r in rows if measures(r[1])[6]]
    got = stages["quality rules"](spark, docs, path)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(r[:2] for r in kept)
    assert all(r.n_chars == len(r.text) for r in got.collect())

    component = jaccard_components([r[:2] for r in kept])
    kept = [r for r in kept if component[r[0]][1] == r[0]]
    got = stages["n-gram Jaccard join"](spark, got, path)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(r[:2] for r in kept)

    assert any(x[2] for x in leaks([r[:2] for r in kept], [(1, item)]))
    got = stages["benchmark decontamination"](spark, got, path)
    assert got.columns == docs.columns
    clean = {r.doc_id: r.text for r in got.collect()}
    assert sorted(clean) == sorted(r[0] for r in kept)
    assert not any(x[2] for x in leaks(list(clean.items()), [(1, item)]))
    assert clean == {r[0]: without(r[1], item) for r in kept}

    before = got.collect()
    got = stages["mixing sources"](spark, got, path)
    assert got.columns == docs.columns
    mixed = got.collect()
    size = lambda rs, s: sum(len(words(r.text)) for r in rs if r.source == s)
    assert abs(sum(size(mixed, s) for s in {r.source for r in before}) - 1.5 * sum(size(before, s) for s in {r.source for r in before})) < 600

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = sorted((tuple(r) for r in stages["token-ID output"](spark, got, path).collect()), key=lambda r: r[1])
    at, expected = 0, []
    for r in sorted(mixed, key=lambda r: (r.doc_id, r.text.encode())):
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        expected.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert last == expected


def test_run_equals_its_stages(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, docs.collect()))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
