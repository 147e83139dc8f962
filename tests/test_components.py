"""Components, condensation and chains against plain Python."""

import random

import pytest

from weftgraph.operators import components as C


def graph(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]


def reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    closed = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        closed[a] = seen
    return out, closed


def longest(out, start, most):
    best, todo = 0, [(start,)]
    while todo:
        p = todo.pop()
        best = max(best, len(p) - 1)
        if len(p) <= most:
            todo += [(*p, y) for y in out[p[-1]] if y not in p]
    return best


@pytest.mark.parametrize("seed,n,m", [(1, 12, 14), (2, 20, 26), (3, 15, 60), (4, 30, 25)])
def test_equal_plain_python(spark, seed, n, m):
    rows = graph(seed, n, m)
    df = spark.createDataFrame(rows, "src string, dst string").repartition(2)
    pairs = [(a, b) for a, b in rows if a != b]
    out, closed = reach(pairs)
    expected = {a: min(b for b in closed[a] if a in closed[b]) for a in out if a in closed[a]}
    found = C.strongly_connected(df)
    assert {r.id: r.component for r in found.collect()} == expected
    flat = {(expected.get(a, a), expected.get(b, b)) for a, b in pairs} - {(x, x) for x in out}
    condensed = C.condensation(df, found)
    assert {(r.src, r.dst) for r in condensed.collect()} == flat
    f_out, _ = reach(flat)
    assert {r.id: r.depth for r in C.longest_chains(condensed).collect()} == {a: longest(f_out, a, 99) for a in f_out}
    for most, beam in ((6, 4), (3, 1)):
        got = {r.start: r.depth for r in C.chain_depths(df, most, beam).collect()}
        assert got == {a: min(most, longest(out, a, most)) for a in out if out[a]}
    cycles = {r.component: r.nodes for r in C.shortest_cycles(df, found).collect()}
    assert set(cycles) == set(expected.values())
    for c, nodes in cycles.items():
        if nodes is not None:
            assert nodes[0] == c and all((a, b) in pairs for a, b in zip(nodes, [*nodes[1:], c], strict=True)) and len(set(nodes)) == len(nodes)


def test_no_pairs_and_a_star(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert C.strongly_connected(none).count() == 0 and C.chain_depths(none).count() == 0 and C.longest_chains(none).count() == 0
    # all cycles pass the centre, so that no simple path is long although walks are
    star = [("c", f"l{i}") for i in range(9)] + [(f"l{i}", "c") for i in range(9)]
    df = spark.createDataFrame(star, "src string, dst string")
    assert {r.start: r.depth for r in C.chain_depths(df).collect()} == {"c": 1, **{f"l{i}": 2 for i in range(9)}}
    assert {r.component: r.nodes for r in C.shortest_cycles(df, C.strongly_connected(df)).collect()} == {"c": ["c", "l0"]}
