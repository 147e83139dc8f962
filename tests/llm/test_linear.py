"""Texts that repeat themselves take time in proportion to their length."""

import random
import time

from pyspark.sql import functions as F

from weftgraph.llm import decontamination as D
from weftgraph.llm import line_dedup as L


def test_an_item_of_equal_words(spark):
    began = time.time()
    words = [7] * 200_000
    machine = D.SuffixAutomaton([("a", words), ("b", [7, 7, 7])], 10)
    hits = list(machine.stream([7] * 200_000))
    assert time.time() - began < 20
    assert sum(1 for a, b, _ in hits if b - a == 10) == 200_000 - 9
    assert sum(1 for a, b, _ in hits if b - a == 3) == 200_000 - 2
    bench = spark.createDataFrame([("a", "x " * 100_000)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "y " + "x " * 150_000), (2, "x " * 9)], "doc_id bigint, text string")
    got = {r["row"]["doc_id"]: (r.n_words, [(s["first"], s["end"]) for s in r.spans]) for r in D.find_leaks(docs, bench).collect()}
    assert got == {1: (150_001, [(1, 150_001)]), 2: (9, [])}


def test_triples_of_a_line_are_numbered(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab") for _ in range(n)) for n in (3, 4, 25, 300)] + ["é" * 40]
    got = {r.line: r.g for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", L._grams(F.col("line")).alias("g")).collect()}
    for line in lines:
        assert len(got[line]) == len(set(got[line])) == len(line) - 2
    # an edit changes three triples
    one = spark.createDataFrame([("the quick brown fox jumps over the lazy dog",), ("the quick brown fix jumps over the lazy dog",)], "line string").select(L._grams(F.col("line")).alias("g")).collect()
    assert len(set(one[0].g) ^ set(one[1].g)) == 6


def test_lines_of_a_megabyte(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    began = time.time()
    texts = spark.createDataFrame([(long,), (long[:-1] + "X",), ("ab" * 500_000,)], "line string")
    assert texts.select(F.size(L._grams(F.col("line"))).alias("n")).agg(F.sum("n")).first()[0] == 3 * 999_998
    assert time.time() - began < 60
    docs = spark.createDataFrame([(1, long), (2, long[:500_000] + "X" + long[500_001:]), (3, "short line of words that is long enough")], "doc_id bigint, text string")
    got = {r.doc_id: (r.class_doc_id, r.copy) for r in L.line_classes(docs)[0].collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False)}
