import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftgraph.llm import line_dedup as L
from weftgraph.llm import shared


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n, alphabet):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice(alphabet))
        elif at < len(s):
            if kind == 1:
                del s[at]
            else:
                s[at] = rng.choice(alphabet)
    return "".join(s)


def test_banded_distance_equals_the_full_table(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        pairs.append((a, edited(rng, a, rng.randint(0, 4), "abé")))
    for k in (1, 2):
        got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.within(F.col("a"), F.col("b"), k).alias("d")).collect()
        assert all(r.d == min(distance(r.a, r.b), k + 1) for r in got)


def brute(rows):
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\f\r")]
    kinds = sorted({x for *_, x in lines})
    parent = {x: x for x in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            n = min(len(a), len(b))
            k = 2 if n >= 40 else 1 if n >= 20 else 0
            if k and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                parent[find(a)] = find(b)
    first = {}
    for d, i, x in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(find(x), (d, i))
    return sorted(((d, i, *first[find(x)], first[find(x)] != (d, i)) for d, i, x in lines), key=str)


def corpus(rng, docs):
    alphabet = "abcdefgh é"
    seeds = ["".join(rng.choice(alphabet) for _ in range(rng.choice([15, 19, 20, 25, 39, 40, 60]))) for _ in range(25)]
    out = []
    for d in range(docs):
        lines = [edited(rng, rng.choice(seeds), rng.choice([0, 0, 1, 1, 2, 3]), alphabet) for _ in range(rng.randint(0, 6))]
        out.append((d, "\n".join([*lines, "", "  "])))
    return out


SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def test_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [*corpus(rng, 60), (None, "a line that has no document id of its own"), (70, None), (71, ""), (72, "x" * 30000), (73, "x" * 29999 + "y")]
    for paired in (8, 2):  # the second sends more keys through stars and the second step
        monkeypatch.setattr(L, "PAIRED", paired)
        lines, links = L.line_classes(spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit("clash")).withColumn("key", F.lit(1)))
        got = sorted((tuple(r) for r in lines.select("doc_id", "line_no", "class_doc_id", "class_line_no", "copy").collect()), key=str)
        assert got == sorted([*brute(rows[:-2]), (72, 0, 72, 0, False), (73, 0, 72, 0, True)], key=str)


def test_all_links_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK", 7)
    base = "the same line of more than forty characters in all its copies"
    kinds = [base, *(base[:i] + x + base[i + 1 :] for i in range(2, 60, 3) for x in "#%")]
    expected = {(a, b) for a in kinds for b in kinds if a < b and distance(a, b) <= 2}
    _, links = L.line_classes(spark.createDataFrame([(i, x) for i, x in enumerate(kinds)], SCHEMA))
    ids = {r.h: r.x for r in spark.createDataFrame([(x,) for x in kinds], "x string").select("x", F.xxhash64("x").bitwiseAND(F.lit(-2)).alias("h")).collect()}
    got = [tuple(sorted((ids[r.a], ids[r.b]))) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(got) == 41 * 20


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.line_classes(empty)[0].count() == 0
    line = "the same line of more than forty characters in all"
    twice = spark.createDataFrame([(1, line), (1, line), (2, f"{line}\n{line}!")], SCHEMA)
    assert sorted(tuple(r) for r in L.line_classes(twice)[0].collect()) == [(1, 0, 1, 0, False), (1, 0, 1, 0, False), (2, 0, 1, 0, True), (2, 1, 1, 0, True)]
    kept = {r.doc_id: r.text for r in L.without_copies(twice.withColumn("row", F.lit(3))).collect()}
    assert kept == {1: line, 2: ""}


def test_a_hot_group_of_lines_that_are_mostly_apart(spark):
    """Copies of one line with a word changed: they share most segments, few are linked."""
    rng = random.Random(6)
    base = "the quick brown fox jumps over the lazy dog while seven wizards boil their kettle".split()
    kinds = {" ".join(base)}
    while len(kinds) < 320:
        words = list(base)
        at = rng.randrange(len(words))
        words[at] = "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 4, 7, 8])))
        kinds.add(" ".join(words))
        if rng.random() < 0.2:
            kinds.add(edited(rng, rng.choice(sorted(kinds)), 1, "abc "))
    rows = [(i, x) for i, x in enumerate(sorted(kinds))]
    lines, _ = L.line_classes(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in lines.select("doc_id", "line_no", "class_doc_id", "class_line_no", "copy").collect()), key=str)
    assert got == brute(rows) and len({r[2] for r in got}) > 100
