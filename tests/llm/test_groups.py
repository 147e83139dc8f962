"""Large groups of near copies: leaders, differences to them, and long sets, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pairs_and_windows import SCHEMA, jaccard_components

from weftgraph.llm import ngram_join as N
from weftgraph.llm import shared


def changed(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.random()
        new = f"n{rng.randrange(10**6)}"
        w[at : at + (kind < 0.7)] = [] if 0.5 < kind < 0.7 else [new]
    return w


@pytest.mark.parametrize("length,copies", [(150, 320), (2600, 40)])
def test_near_copies_of_which_many_are_too_far_from_the_leader(spark, length, copies):
    rng = random.Random(length)
    base = [f"v{i}" for i in range(length)]
    rows = [(1000, " ".join(base))]
    for i in range(copies):
        if i % 5 == 4:  # a copy of a copy
            w = changed(rng, rng.choice(rows)[1].split(), rng.randint(0, 2 * length // 150))
        else:
            w = changed(rng, base, rng.randint(0, 6 * length // 150))
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[: length - i * (length // 30)])) for i in range(1, 12)]
    expected = jaccard_components(rows)
    assert len({c for _, c in expected.values()}) > 5
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    members, links = N.jaccard_classes(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_beyond_leaders_lose_no_link(spark, seed):
    """Sets around leaders; every close pair that is in different components must be found."""
    rng = np.random.default_rng(seed)
    sets, rest = {}, []
    for g in range(3):
        center = set(range(g * 1000, g * 1000 + 60))
        sets[g * 100] = center
        for i in range(1, 60):
            x = set(center) if rng.random() < 0.6 else set(sets[g * 100 + int(rng.integers(0, i))])
            for _ in range(int(rng.integers(0, 12))):
                if rng.random() < 0.5:
                    x.discard(int(rng.choice(sorted(x))))
                else:
                    x.add(int(rng.integers(g * 1000, g * 1000 + 200)))
            sets[g * 100 + i] = x
    close = lambda a, b: 9 * len(sets[a] ^ sets[b]) <= len(sets[a]) + len(sets[b])
    linked = {i: i // 100 * 100 if close(i, i // 100 * 100) else i for i in sets}
    rest = [(i // 100 * 100, i, linked[i]) for i in sets]
    wanted = {(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and linked[a] != linked[b] and close(a, b)}
    assert wanted
    frame = spark.createDataFrame(rest, "g bigint, id bigint, component bigint")
    elements = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in sets.items()], "id bigint, elements array<bigint>")
    found = {(r.a, r.b) for r in shared.beyond_leaders(frame, elements, lambda n, m: F.floor((n + F.least(m, F.floor(n * 100 / 80))) * 20 / 180)).collect()}
    assert wanted <= found
    # a bound that doesn't depend on the size: differences of a pair may have nothing in common
    near = lambda a, b: len(sets[a] ^ sets[b]) <= 8
    rest = [(g, i, i) for g, i, _ in rest]
    wanted = {(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and near(a, b)}
    frame = spark.createDataFrame(rest, "g bigint, id bigint, component bigint")
    found = {(r.a, r.b) for r in shared.beyond_leaders(frame, elements, lambda n, m: F.lit(8), True).collect()}
    assert wanted <= found


def executions(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    return store, [found.apply(i) for i in range(found.size())]


def joined_rows(spark, keys, since):
    """Largest number of rows that a join on ``keys`` made in the executions after the one numbered ``since``."""
    store, found = executions(spark)
    seq = lambda x: [x.apply(i) for i in range(x.size())]
    most = 0
    for execution in (e for e in found if e.executionId() > since):
        values = store.executionMetrics(execution.executionId())
        for node in seq(store.planGraph(execution.executionId()).allNodes()):
            if "Join" in node.name() and re.search(r"Join \[" + ", ".join(rf"{k}#\d+L?" for k in keys) + r"\]", node.desc()):
                for m in seq(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_elements_of_an_unlike_leader_make_no_row_a_member(spark):
    """Members share a passage with their leader and lack the rest of it; few of them are linked."""
    passage, rest_of_leader, members = list(range(40)), list(range(100, 300)), 150
    sets = {0: passage + rest_of_leader}
    for i in range(1, members):
        like = i - 1 if i % 10 == 0 else i  # every tenth is a near copy of the one before
        sets[i] = passage + [1000 * like + k for k in range(60 - 2 * (like != i))] + [300 + i % 7]
    close = lambda a, b: 9 * len(set(sets[a]) ^ set(sets[b])) <= len(sets[a]) + len(sets[b])
    wanted = {(a, b) for a in sets for b in sets if a < b and close(a, b)}
    assert len(wanted) == 14
    frame = spark.createDataFrame([(0, i, i) for i in sets], "g bigint, id bigint, component bigint")
    elements = spark.createDataFrame(list(sets.items()), "id bigint, elements array<bigint>")
    before = max((e.executionId() for e in executions(spark)[1]), default=-1)
    found = {(r.a, r.b) for r in shared.beyond_leaders(frame, elements, lambda n, m: F.floor((n + F.least(m, F.floor(n * 100 / 80))) * 20 / 180)).collect()}
    assert wanted <= found
    assert 0 < joined_rows(spark, ("g", "e"), before) < members * 20 < members * len(rest_of_leader)


def generated_rows(spark, since):
    """Largest number of rows that an explode made in the executions after the one numbered ``since``."""
    store, found = executions(spark)
    seq = lambda x: [x.apply(i) for i in range(x.size())]
    most = 0
    for execution in (e for e in found if e.executionId() > since):
        values = store.executionMetrics(execution.executionId())
        for node in seq(store.planGraph(execution.executionId()).allNodes()):
            if node.name() == "Generate":
                for m in seq(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_members_that_can_be_linked_with_none_show_few_elements(spark):
    """Most members have only a passage in common, and a few frequent elements; some pairs are linked just so."""
    passage, members = list(range(30)), 120
    sets = {0: passage + list(range(100, 200))}
    for i in range(1, members):
        sets[i] = passage + [1000 * i + k for k in range(100, 165)] + [300 + i % 3, 310 + i % 5]
    # 20 elements apart of 180, those of one member only, which come first: on one side, and on both
    sets[200], sets[201] = [10**6 + k for k in range(20, 100)], [10**6 + k for k in range(100)]
    sets[202], sets[203] = [2 * 10**6 + k for k in range(10, 100)], [2 * 10**6 + k for k in (*range(10), *range(20, 100))]
    sets[204] = [3 * 10**6 + k for k in range(900)]
    close = lambda a, b: 9 * len(set(sets[a]) ^ set(sets[b])) <= len(sets[a]) + len(sets[b])
    wanted = {(a, b) for a in sets for b in sets if a < b and close(a, b)}
    assert wanted == {(200, 201), (202, 203)}
    reach = lambda n, m: F.floor((n + F.least(m, F.floor(n * 100 / 80))) * 20 / 180)
    for ids in (sets, [i for i in sets if i != 204]):
        frame = spark.createDataFrame([(0, i, i) for i in ids], "g bigint, id bigint, component bigint")
        elements = spark.createDataFrame([(i, sets[i]) for i in ids], "id bigint, elements array<bigint>")
        before = max((e.executionId() for e in executions(spark)[1]), default=-1)
        assert wanted <= {(r.a, r.b) for r in shared.beyond_leaders(frame, elements, reach).collect()}
    # sets have 97 elements on average, of which 21 may differ: 43 elements are looked at instead of all 167
    assert 0 < generated_rows(spark, before) <= (members + 4) * 43 < sum(len(set(sets[i]) ^ set(sets[0])) for i in ids) / 3


def test_leader_has_the_most_keys(spark):
    members = [(k, 7) for k in range(6)] + [(k, 10 + k) for k in range(6)] + [(k, 20 + k) for k in range(6)] + [(9, 3)]
    frame = spark.createDataFrame(members, "key bigint, id bigint")
    got = {(r.g, r.id) for r in shared.led(frame).collect()}
    assert got == {(7, i) for k, i in members if k != 9} | {(3, 3)}


def test_sketches_grow_with_the_set_and_fold(spark):
    rng = np.random.default_rng(9)
    for sizes in ([10, 300, 3000], [1200, 2600, 1]):
        hashes = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
        sketch, words = N._sketches(hashes, np.array(sizes), 80, 100)
        assert words.sum() == len(sketch) and all(w * 64 >= 8 * (2 * n // 9) for w, n in zip(words, sizes))
    one, wo = N._sketches(hashes[:1200], np.array([1200]), 80, 100)
    two, wt = N._sketches(hashes[1200:3800], np.array([2600]), 80, 100)
    row = spark.createDataFrame([(1200, 2600, one.tolist(), two.tolist())], "n int, m int, u array<bigint>, v array<bigint>")
    assert not row.select(N._near(F.col("n"), F.col("m"), F.col("u"), F.col("v"), 40, 100)).first()[0]
    assert row.select(N._near(F.col("n"), F.col("n"), F.col("u"), F.col("u"), 80, 100)).first()[0]
    assert wo[0] < wt[0] and not row.select(N._near(F.lit(2100), F.col("m"), F.col("u"), F.col("v"), 80, 100)).first()[0]
