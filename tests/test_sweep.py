"""Sweeps: fixed texts before patterns, files dealt to all tasks, lines with the ones after them."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import receivers, resolve, signatures, values
from weftgraph.plans import bind, queries
from weftgraph.sources import corpus
from weftgraph.sources.shared import kept, spread

DIR = "/root/testdata/sf0.001"


def test_texts_that_a_pattern_cannot_do_without():
    assert T.literals(r"\b(nc|js|nats)\.(p|P)ublish\(") == (("ublish(", False),)
    assert T.literals(r"(?i)rabbit|pika|Rabbitmq") == (("pika", True), ("rabbit", True))
    assert T.literals(r"a(?i:Bcde)|xyz?w") == (("bcde", True), ("xy", False))
    assert T.literals(r"\w+|\bfetch\(") == T.literals(r"x*") == T.literals(r"(fetch)?") == ()
    assert all(T.literals(s.pattern) and (s.gate is None or T.literals(s.gate)) for s in signatures.SIGNATURES)


def test_search_for_texts_loses_no_match(spark):
    """All patterns against all lines of both corpora, in upper and lower case as well."""
    patterns = [s.pattern for s in signatures.SIGNATURES] + [s.gate for s in signatures.SIGNATURES if s.gate] + [values.READ, resolve._CHANNEL, resolve._ADDRESS, resolve._URL, *resolve._OPENERS, *resolve.VENDORS.values(), *signatures.STUBS, *signatures.REGISTRATIONS]
    patterns += [rf"(?:{c.types})" for c in receivers.CLIENTS] + [rf"(?:{c.factories})" for c in receivers.CLIENTS]
    lines = corpus.split_lines(bind.sources(spark, DIR).unionByName(bind.idioms(spark, DIR))).select("text").distinct()
    lines = kept(lines.unionByName(lines.select(F.upper("text").alias("text"))).unionByName(lines.select(F.lower("text").alias("text"))))
    lost = lines.select(F.array_compact(F.array(*(F.when(F.col("text").rlike(p) & ~T.may_match(F.col("text"), p), F.lit(p)) for p in patterns))).alias("lost"))
    assert lost.filter("size(lost) > 0").count() == 0


def test_files_of_a_small_scan_are_dealt_to_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = bind.sources(spark, DIR).coalesce(1)
    assert spread(files).rdd.getNumPartitions() == n
    _, lines = queries._swept(files)
    assert sum(1 for x in lines.rdd.glom().map(len).collect() if x) == n


def test_lines_have_the_ones_after_them(spark):
    files = spark.createDataFrame([("a", "x\ny\n\nz\n"), ("b", "x"), ("c", ""), ("d", None)], "path string, text string")
    got = {(r.path, r.line): (r.text, r.after) for r in corpus.split_lines(files, 2).collect()}
    assert got == {("a", 1): ("x", ["y", ""]), ("a", 2): ("y", ["", "z"]), ("a", 3): ("", ["z"]), ("a", 4): ("z", []), ("b", 1): ("x", [])}
    plain = corpus.split_lines(files)
    assert got == {(r.path, r.line): (r.text, r.after) for r in corpus.after_hits(plain, plain, 2).collect()}


@pytest.mark.parametrize("corpus_of", [bind.sources, bind.idioms])
def test_hits_are_the_same_with_lines_beside_them(spark, corpus_of):
    files = corpus_of(spark, DIR)
    with_after, plain = corpus.split_lines(files, 2), corpus.split_lines(files)
    rows = lambda lines: sorted(map(repr, signatures.sweep(lines).collect()))
    assert rows(with_after) == rows(plain)


def test_parts_that_grow_too_long_or_need_nothing(spark):
    """Sites of text alone are through without a definition; one with too many parts is computed at run time."""
    many = " + ".join(f'"p{i}"' for i in range(values.MOST_PARTS + 1))
    files = spark.createDataFrame([("a.py", f'import kafka\nproducer.send("plain", x)\nproducer.send({many}, x)\nNAME = "named"\nproducer.send(NAME, x)\n')], "path string, text string")
    lines = corpus.split_lines(files, 2)
    trees = spark.createDataFrame([], "path string, line int, doc int, key string, leaf string, value string")
    found = resolve.ladder(signatures.sweep(lines).filter("family = 'kafka'"), values.definitions(lines), trees)
    assert {r.line: (r.rung, r.value, r.variants) for r in found.collect()} == {2: (1, "plain", ""), 3: (7, None, ""), 5: (2, "named", "")}
