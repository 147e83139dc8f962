"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import suffix_dedup as S

SCHEMA = "doc_id bigint, text string"


def brute(rows, width):
    first, seen = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in seen:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if i is not None and first.get(w, (i, k)) >= (i, k):
                first[w] = (i, k)
    out = []
    for i, b in seen:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1 if i is not None else 0):
            if first[b[k : k + width]] < (i, k):
                gone[k : k + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice("ab éü語\n") for _ in range(k))
    passages = [letters(90) for _ in range(3)]
    base = letters(400)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:  # near copies of one text, each changed in a place of its own
            t = list(base)
            t[rng.randrange(len(t))] = rng.choice("xyzé")
            text = "".join(t)
        elif kind < 0.5:
            text = letters(rng.randint(0, 60)) + rng.choice(passages) + letters(rng.randint(0, 60))
        elif kind < 0.6:
            text = rng.choice("ab") * rng.randint(0, 300)
        elif kind < 0.7:
            text = rng.choice(["ab ", "aab"]) * rng.randint(0, 90)
        else:
            text = letters(rng.randint(0, 120))
        rows.append((i * 3 - 60, text))
    return rows + [(1, None), (2, ""), (4, base), (4, base), (4, base[7:]), (5, base), (None, base), (None, None)]


@pytest.mark.parametrize("seed,width,few,many,piece,suffixes", [(1, 40, 8, 256, 1 << 20, 1 << 20), (2, 40, 1, 2, 300, 500), (3, 7, 2, 3, 64, 5000), (4, 100, 8, 256, 1000, 1 << 20)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, width, few, many, piece, suffixes):
    rows = corpus(seed, 60)
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "PIECE", piece)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("tag", F.lit("clash")).withColumn("bucket", F.lit(1))
    df = S.remove_repeated_bytes(docs, width, bucket_bytes=4000, bucket_suffixes=suffixes)
    assert got(df) == brute(rows, width)


@pytest.mark.parametrize("few,many", [(8, 256), (1, 2), (2, 4)])
def test_passes_in_one_process(monkeypatch, few, many):
    """The same passes without Spark, so that small limits hold in them: hot digits, small pieces."""
    import pyarrow as pa

    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "PIECE", 512)
    width, buckets = 40, 5
    rows = [r for r in corpus(9, 80) if r[0] is not None]
    seen = {}
    rows = [seen.setdefault(i, (i, t)) for i, t in rows if i not in seen]
    part = lambda k: pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows[k::2]]), "tag": pa.array([0 for _ in rows[k::2]], pa.int32()), "text": pa.array([t for _, t in rows[k::2]])})

    def grouped(found, decide):
        table = pa.Table.from_batches(found)
        keys = sorted(set(table.column("bucket").to_pylist()))
        return pa.concat_tables([decide((pa.scalar(b),), table.filter(pa.compute.equal(table.column("bucket"), b))) for b in keys]).to_pylist()

    places = grouped([b for k in range(2) for b in S._first_digits(width, buckets)(iter([part(k)]))], S._runs_decided)
    of = lambda p, kinds: [{c: p[c] for c in ("start", "n", "kind", "deal")} for p in p if p["kind"] in kinds]
    opened = [[x for x in places if x["doc_id"] == i and x["kind"]] for i, _ in rows]
    struct = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "n", "kind", "deal")]))
    if few < 8:
        assert any(x["kind"] == S._HOT for p in opened for x in p)
    batches = [pa.RecordBatch.from_arrays([*part(k).columns, pa.array([of(p, (1, 2)) or None for p in opened[k::2]], struct)], ["doc_id", "tag", "text", "open"]) for k in range(2)]
    late = grouped([b for x in batches for b in S._open_bytes(width, buckets)(iter([x]))], S._windows_decided(width))
    gone = [x for x in places if not x["kind"]] + late
    struct = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
    gone = [[{"start": x["start"], "n": x["n"]} for x in gone if x["doc_id"] == i] or None for i, _ in rows]
    out = [r for k in range(2) for b in S._cut(width)(iter([pa.RecordBatch.from_arrays([*part(k).columns, pa.array(gone[k::2], struct)], ["doc_id", "tag", "text", "gone"])])) for r in b.to_pylist()]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute(rows, width)
    assert all(sum(s["end"] - s["first"] for s in r["removed"]) == r["n_removed"] for r in out)


def test_very_long_text_and_empty_table(spark):
    assert S.remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    rows = [(1, long), (2, "x" * 3_000_000), (3, "before " + long[1_000_000:1_200_000] + " after")]
    out = {r.doc_id: r for r in S.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[1].n_removed, out[1].n_spans) == (0, 0)
    assert (out[2].n_removed, bytes(out[2].kept)) == (3_000_000 - 1, b"x")
    assert bytes(out[3].kept) == b"before  after" and out[3].n_spans == 1


def test_radix_groups_are_the_equal_windows():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 4000, dtype=np.uint8)
    at = np.arange(len(data) - 11)
    index, group = S.radix_groups(data, at, 11)
    by_window = {}
    for i in at.tolist():
        by_window.setdefault(data[i : i + 11].tobytes(), []).append(i)
    expected = sorted(x for x in by_window.values() if len(x) > 1)
    assert sorted(sorted(index[group == g].tolist()) for g in np.unique(group)) == expected
