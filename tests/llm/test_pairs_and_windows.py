"""N-gram join, substring dedup and decontamination against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftgraph.llm import decontamination as D
from weftgraph.llm import ngram_join as N
from weftgraph.llm import shared
from weftgraph.llm import substring_dedup as S

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed, n, vocabulary=40, most=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    passages = [" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.35:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            text = "  ".join(w).upper() if kind < 0.05 else " ".join(w)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, most)))
            if kind > 0.8:
                text += "\n" + rng.choice(passages)
        rows.append((i * 3, text))
    rows += [(1, None), (2, ""), (4, " \t\n"), (5, "one two"), (7, "one two"), (8, "ONE two"), (10, "w " * 8000)]
    rng.shuffle(rows)
    return rows


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed,paired,common", [(1, 8, 100_000), (2, 2, 100_000), (3, 2, 0)])
def test_components_equal_brute_force(spark, monkeypatch, seed, paired, common):
    monkeypatch.setattr(N, "COMMON", common)
    monkeypatch.setattr(N, "PAIRED", paired)
    rows = corpus(seed, 150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("rep", F.lit("x")).withColumn("key", F.lit(0))
    members, links = N.jaccard_classes(docs, bucket_bytes=4000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()}
    assert got == jaccard_components(rows)
    assert all(r.a < r.b for r in links.collect())


def test_links_across_interval_borders(spark):
    """One document per partition: partners of the next size interval are in no slice of one another."""
    rows = []
    for k, (small, large) in enumerate(((100, 120), (90, 110), (116, 145), (73, 91), (22, 27), (13, 16), (5, 6), (100, 126))):
        rows += [(10 * k + j, " ".join(f"v{k}x{i}" for i in range(size + 4))) for j, size in enumerate((large, small))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), SCHEMA)
    members, links = N.jaccard_classes(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == jaccard_components(rows)
    assert sorted((r.a, r.b) for r in links.collect()) == [(10 * k, 10 * k + 1) for k in range(7)]


def test_all_links_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK", 7)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join([*base, *(f"own{i}x{k}" for k in range(i % 9 + 1))])) for i in range(40)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    expected = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    _, links = N.jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(2))
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(got) > 700
    counts = {r.id: r.n_links for r in shared.link_counts(links).collect()}
    assert counts == {i: sum(i in x for x in expected) for i in sets}


def test_join_edge_cases(spark):
    assert N.jaccard_classes(spark.createDataFrame([], SCHEMA))[0].count() == 0
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (1, "A b C d e f g"), (None, "a b c d e f g"), (None, None)]
    members, _ = N.jaccard_classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((str(r.doc_id), r.n_shingles) for r in members.collect()) == [("1", 3), ("3", 3), ("3", 3), ("None", 0), ("None", 3)]
    assert {r.component_id for r in members.collect() if r.doc_id} == {1}
    kept = N.one_of_each(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(9)))
    assert kept.columns == ["doc_id", "text", "id"] and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None"]


def repeated(rows, width=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed,width", [(4, 13), (5, 3)])
def test_repeated_windows_equal_brute_force(spark, seed, width):
    rows = corpus(seed, 120)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("hashes", F.lit(1))
    got = S.remove_repeated_windows(docs, width, bucket_bytes=3000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got} == repeated(rows, width)
    for r in got:
        assert sum(x["end"] - x["first"] for x in r.removed) == r.n_removed


def test_window_edge_cases(spark):
    assert S.remove_repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(2, text), (2, text), (None, text), (5, f"x {text} y"), (6, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.remove_repeated_windows(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("2", 20, 0, text), ("2", 20, 0, text), ("5", 22, 20, "x y"), ("6", 0, 0, ""), ("None", 20, 0, text)]


def leaks(rows, items, width=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: pattern.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = norm(t)
        if w:
            for k in range(max(1, len(w) - width + 1)):
                windows[tuple(w[k : k + width])].add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = norm(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((str(i), len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [100_000, 25])
def test_leaks_equal_brute_force(spark, block_words):
    rng = random.Random(8)
    some = lambda most: " ".join(rng.choice(["a", "b", "C", "é", "7"]) for _ in range(rng.randint(0, most)))
    items = [(i, some(16)) for i in range(30)] + [(3, "a b c"), (None, "é é é é"), (50, None), (51, "…!")]
    rows = [(i, some(70)) for i in range(150)] + [(200, None), (201, ""), (None, "A, b. (c)"), (202, "x " * 20000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(1)).withColumn("items", F.lit("clash"))
    found = D.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words)
    got = sorted((str(r["row"]["doc_id"]), r.n_words, sum(s["end"] - s["first"] for s in r.spans), r["items"]) for r in found.collect())
    assert got == leaks(rows, items)


def test_leaks_without_items_and_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    rows = [(1, "Before. One, two three four five six seven eight nine ten! " + "after " * 20), (2, "one two three four five six seven eight nine ten eleven"), (3, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(5))
    none = D.find_leaks(docs, bench.limit(0)).collect()
    assert [len(r.spans) for r in none] == [0, 0, 0]
    out = {r.doc_id: r.text for r in D.decontaminate(docs, bench).collect()}
    assert out == {1: "Before. ! " + "after " * 20, 3: None}
    assert D.decontaminate(docs, bench).columns == docs.columns
