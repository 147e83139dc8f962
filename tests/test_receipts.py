"""Receipts: gathered by the hash of the key, merged within the row, and not gathered where only their number counts."""

from pyspark.sql import functions as F

from weftgraph.operators import consolidate, review
from weftgraph.plans import bind, queries

SIGHTING = "actor string, rel string, object string, label string, tag string, path string, line int, note string"
DIR = "/root/testdata/sf0.001"
ROWS = [
    ("a", "http", "b", "-", "CODE", "x", 2, None),
    ("a", "http", "b", "-", "CODE", "x", 1, None),
    ("a", "http", "b", "-", "CODE", "x", 1, None),
    ("a", "http", "b", "-", "INFERENCE", "w", 5, "confirm: w"),
    ("a", "http", "b", "-", "INFERENCE", "x", 9, "confirm: x"),
    ("a", "http", "b", "-", "CODE", "y", 3, "sure"),
    ("a", "http", None, None, "INFERENCE", "z", 4, "confirm: z"),
    ("a", "http", "c", "-", "CODE", "z", 4, None),
    ("a", "http", "c", "-", "CODE", "z", 4, None),
]


def _rows(edges):
    return {(e.actor, e.object): (e.tag, [(r.path, list(r["lines"])) for r in e.receipts], e.note) for e in edges.collect()}


def test_consolidated_receipts(spark):
    got = _rows(consolidate.consolidate(spark.createDataFrame(ROWS, SIGHTING)))
    assert got == {
        ("a", "b"): ("CODE", [("x", [1, 2, 9]), ("y", [3]), ("w", [5])], "sure"),
        ("a", None): ("INFERENCE", [("z", [4])], "confirm: z"),
        ("a", "c"): ("CODE", [("z", [4])], None),
    }


def test_merge_puts_receipts_together_within_the_row(spark):
    edge = "actor string, rel string, object string, label string, tag string, receipts array<struct<path:string,lines:array<int>>>, note string"
    side = lambda *rows: spark.createDataFrame([("a", "http", o, "-", tag, receipts, note) for o, tag, receipts, note in rows], edge)
    left = side(("same", "CODE", [("y", [2, 1]), ("x", [3])], None), ("both", "INFERENCE", [("x", [1]), ("a", [9])], "confirm: l"), ("said", "UNVERIFIED", [], "confirm: said"), ("left", "CODE", [("q", [1])], None))
    right = side(("same", "CODE", [("y", [2, 1]), ("x", [3])], "n"), ("both", "CODE", [("z", [4]), ("x", [2])], None), ("said", "CODE", [("m", [1])], None), ("right", "CODE", [("r", [1])], None))
    merged = consolidate.merge(left, right)
    assert _rows(merged) == {
        ("a", "same"): ("CODE", [("x", [3]), ("y", [1, 2])], "n"),
        ("a", "both"): ("CODE", [("x", [2, 1]), ("z", [4]), ("a", [9])], None),
        ("a", "said"): ("CODE", [("m", [1])], None),
        ("a", "left"): ("CODE", [("q", [1])], None),
        ("a", "right"): ("CODE", [("r", [1])], None),
    }
    # the receipts of both sides went through a second shuffle, place by place
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 0


def test_tags_are_grouped_before_their_notes_are_compared(spark):
    seen = spark.createDataFrame(ROWS, SIGHTING)
    plan = consolidate.edge_tags(seen)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
    tags = {(e.actor, e.object): (e.tag, e.note, e.single) for e in consolidate.edge_tags(seen, single=True).collect()}
    assert tags == {("a", "b"): ("CODE", "sure", False), ("a", None): ("INFERENCE", "confirm: z", True), ("a", "c"): ("CODE", None, True)}


def test_rules_need_no_receipts(spark):
    with_receipts = consolidate.consolidate(bind.sightings(spark, DIR))
    found = lambda e: sorted(map(repr, review.t8_hard_wired(e).select("finding", "evidence").collect()))
    assert found(queries._singles(spark, DIR)) == found(with_receipts) != []
