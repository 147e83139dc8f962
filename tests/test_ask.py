import pytest
from pyspark.sql import functions as F

from test_ledger import LEDGER, load
from weftgraph.operators import consolidate, resolve
from weftgraph.plans import ask
from weftgraph.schema import AmbiguousSubject
from weftgraph.sources.corpus import split_lines


def test_questions_are_parsed():
    assert ask.parse("impact basket") == ask.Question("impact", ("basket",))
    assert ask.parse("path a b") == ask.Question("path", ("a", "b"))
    assert ask.parse("what breaks if `basket` goes down?") == ask.Question("impact", ("basket",))
    assert ask.parse("show me everything").lens == "overview"
    with pytest.raises(AmbiguousSubject):
        ask.parse("focus")


def test_questions_are_answered(spark):
    _, nodes, edges, _ = load(spark, LEDGER)
    nodes, edges = nodes.drop("line_no"), edges.drop("line_no")
    assert {r.node for r in ask.ask(nodes, edges, "impact basket").collect()} == {"courier", "ledger"}
    assert ask.ask(nodes, edges, "focus courier", kinds=("ext",)).count() == 1
    with pytest.raises(AmbiguousSubject):
        ask.ask(nodes, edges, "focus er")
    ask.register("messages", ask.where(F.col("rel").isin("pub", "sub")))
    assert ask.ask(nodes, edges, "messages").count() == 4
    words = {r.sentence for r in ask.wording(edges).collect()}
    assert "ledger appears to grpc quotes (unconfirmed: confirm: where quotes is served)" in words
    said = spark.createDataFrame([("basket", "http", "quotes", "-", "told so"), ("basket", "uses", "order-db", "sql", "known")], "actor string, rel string, object string, label string, note string")
    assert [r.tag for r in consolidate.with_assertions(edges, said).filter("tag = 'UNVERIFIED'").collect()] == ["UNVERIFIED"]
    one = edges.withColumn("shard", F.lit(1))
    assert ask.shard_footers(one, one.limit(2), one).first().asDict() == {"shard": 1, "hits": 9, "code": 8, "inferred": 1, "gaps": 2}
    assert not ask.worth_sharding(nodes, edges).first()["shard"]


def test_vendors_and_optional_backends(spark):
    lines = split_lines(spark.createDataFrame([("a.py", "stripe.Charge.create(x)\nclient = OpenAI()\nplain()\n")], "path string, text string"))
    assert {(r.vendor, r.line) for r in resolve.vendor_calls(lines).collect()} == {("stripe", 1), ("openai", 2)}
    row = spark.range(1).select(resolve.optional_label(F.lit("redis"), F.lit("if enableCache:")), resolve.optional_label(F.lit("redis"), F.lit("cache()"))).first()
    assert row[:] == ("optional: redis", "redis")
