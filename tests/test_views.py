"""Layout, rendered views and their checks, on hand-made ledgers."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import checks, consolidate, graph, resolve, review, signatures
from weftgraph.plans import render
from weftgraph.schema import EDGES, GAPS, NODES
from weftgraph.sources import corpus


def ledger(spark, edges, kinds=None):
    kinds = kinds or {}
    rows = [(a, r, o, "-", tag, [("f", [1])], None if tag == "CODE" else "confirm: x") for a, r, o, *t in edges for tag in (t or ["CODE"])]
    ids = sorted({x for a, _, o, *_ in edges for x in (a, o)} | set(kinds))
    nodes = [(i, kinds.get(i, "topic" if i[0].isupper() else "svc"), "x", [("f", [1])]) for i in ids]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES)


def test_lineage_draws_only_what_readers_publish(spark):
    _, edges = ledger(spark, [("p", "pub", "T"), ("c", "sub", "T"), ("c", "pub", "U"), ("x", "pub", "U"), ("y", "sub", "U"), ("y", "pub", "T"), ("c", "http", "p")])
    start = spark.createDataFrame([("T",)], "id string")
    got = {(r.actor, r.rel, r.object) for r in graph.lineage(edges, start).collect()}
    assert got == {("p", "pub", "T"), ("c", "sub", "T"), ("c", "pub", "U"), ("y", "sub", "U"), ("y", "pub", "T"), ("c", "http", "p")}
    one = {(r.actor, r.rel, r.object) for r in graph.lineage(edges, start, 0).collect()}
    assert one == {("p", "pub", "T"), ("y", "pub", "T"), ("c", "sub", "T"), ("c", "http", "p")}


def test_hubs_are_services(spark):
    nodes, edges = ledger(spark, [(f"s{i}", "uses", "db-x") for i in range(8)] + [("hub", "http", f"s{i}") for i in range(7)], {"db-x": "db"})
    assert [r.participants for r in review.t6_hub(nodes, edges).collect()] == [["hub"]]


def test_contracts_of_calls(spark):
    nodes, edges = ledger(spark, [("a", "http", "b"), ("a", "grpc", "c"), ("a", "http", "out"), ("a", "grpc", "d")], {"out": "ext"})
    contracts = spark.createDataFrame([("http", "c"), ("grpc", "d")], "rel string, name string")
    assert {r.participants[0] for r in review.t11_unowned_contract(nodes, edges, contracts).collect()} == {"b", "c"}
    assert review.t11_unowned_contract(nodes, edges).count() == 0


def test_layers(spark):
    chain = [(f"n{i:02}", "uses", f"n{i + 1:02}") for i in range(11)]
    nodes, edges = ledger(spark, chain)
    assert {r.id: r["rank"] for r in render.layers(nodes, edges).collect()} == {f"n{i:02}": i for i in range(12)}
    nodes, edges = ledger(spark, [("a", "http", "b"), ("b", "http", "a"), ("b", "pub", "T"), ("c", "sub", "T"), ("c", "http", "a")])
    # the first call in ledger order ranks, its answer doesn't; nor does the callback of the consumer
    assert {r.id: r["rank"] for r in render.layers(nodes, edges).collect()} == {"a": 0, "b": 1, "T": 2, "c": 3}
    nodes, edges = ledger(spark, [("a", "http", "z"), ("b", "http", "y"), ("a", "http", "y"), ("c", "http", "x")])
    assert {r.id: (r["rank"], r["row"]) for r in render.layers(nodes, edges).collect()} == {"a": (0, 0), "b": (0, 1), "c": (0, 2), "z": (1, 0), "y": (1, 1), "x": (1, 2)}


def test_large_views_are_clustered_or_refused(spark):
    nodes, edges = ledger(spark, [(f"shop-{i}", "http", f"api{i}.test") for i in range(20)] + [("shop-0", "http", "shop-1")], {f"api{i}.test": "ext" for i in range(20)})
    row = render.drawio(nodes, edges).first()
    assert row.xml is None and "40 nodes" in row.note
    text = render.overview(nodes, edges).first().mermaid
    assert text.count("subgraph") == 1 and "20 external APIs" in text and 's_shop_0 -->' in text


def test_views_are_well_formed(spark):
    nodes, edges = ledger(spark, [("a", "http", "b"), ("b", "pub", "T"), ("c", "sub", "T", "INFERENCE"), ("c", "uses", "db")], {"db": "db"})
    gaps = spark.createDataFrame([("a", "no route", [("f", [2])])], GAPS)
    view = render.markdown("focus a", nodes, edges.filter("rel <> 'uses'"), answer="It calls b.", commit="abc1", gaps=gaps, ledger=edges).first().view
    assert "ledger abc1" in view and "It calls b." in view and "- gap: a: no route" in view and "- hidden: c → db" in view and "classDef svc" in view
    chart = render.flowchart(nodes, edges)
    assert checks.mermaid_violations(chart).count() == 0
    broken = spark.createDataFrame([("flowchart LR\n  s_a[a]\n  s_a --> s_b\n  class s_c svc",)], "mermaid string")
    assert {r.message for r in checks.mermaid_violations(broken).collect()} == {"label is not quoted:   s_a[a]", "no such node: s_b", "no such node: s_c"}
    xml = render.drawio(nodes, edges)
    assert checks.drawio_violations(xml).count() == 0
    bad = xml.select(F.regexp_replace("xml", 'target="n1"', 'target="n9"').alias("xml"))
    assert xml.first().xml.count("strokeColor") == 4 and [r.message for r in checks.drawio_violations(bad).collect()] in ([], ["no such cell: n9"])
    lines = render.edge_lines(nodes, edges)
    assert checks.view_violations(edges, edges, nodes, lines).count() == 0
    assert checks.view_violations(edges, edges.filter("rel <> 'pub'"), nodes, lines.withColumn("line", F.replace("line", F.lit("-.->"), F.lit("-->"))), 3).count() == 3
    found = review.t2_event_then_callback(edges).unionByName(review.t4_orphan_channel(edges.filter("rel <> 'sub'")))
    page = render.review_view(nodes, edges, found).first().view
    assert page.startswith("4 services") or "services" in page.split("\n")[0]
    assert "| T4 | low | T has no consumer |" in page


def test_paths_rings_and_silent_nodes(spark):
    nodes, edges = ledger(spark, [("a", "pub", "T"), ("b", "sub", "T"), ("b", "http", "c")], {"quiet": "svc", "U": "topic"})
    start = spark.createDataFrame([("a",)], "id string")
    paths = graph.simple_paths(edges, start, spark.createDataFrame([("c",)], "id string"))
    steps = render.path_steps(paths, edges)
    assert [(r.step, r.src, r.dst) for r in steps.orderBy("step").collect()] == [(1, "a", "T"), (2, "T", "b"), (3, "b", "c")]
    assert "-)" in render.sequence(steps).first().mermaid
    table = render.ring_table(graph.impact_reasons(edges, start), edges).first().table
    assert "| 1 | b | consumes T | `f:1` |" in table
    assert {(r.id, r.warning) for r in checks.silent_nodes(nodes, edges).collect()} == {("U", "no producer"), ("quiet", "no edges")}
    assert checks.vague_notes(edges.withColumn("tag", F.lit("INFERENCE")).withColumn("note", F.lit("perhaps"))).count() == 3


def test_receipts_of_mixed_evidence(spark):
    rows = [("a", "pub", "T", "-", t, p, n, None) for t, p, n in (("INFERENCE", "x", 3), ("CODE", "y", 9), ("CODE", "x", 7), ("CODE", "y", 2), ("CODE", "y", 2), ("INFERENCE", "z", 1))]
    edge = consolidate.consolidate(spark.createDataFrame(rows, "actor string, rel string, object string, label string, tag string, path string, line int, note string")).first()
    assert edge.tag == "CODE" and [(r.path, r["lines"]) for r in edge.receipts] == [("x", [7, 3]), ("y", [2, 9]), ("z", [1])]


def test_deployables_name_services(spark):
    files = {
        "compose.yml": "services:\n  shop:\n    build: ./svc/hipster\n  queue:\n    image: rabbitmq:3\n  cache:\n    image: redis:7\n",
        "svc/hipster/go.mod": "module x/hipster\n",
        "svc/pay/package.json": '{\n  "name": "@a/payer"\n}\n',
        "k8s/pay.yaml": "kind: Deployment\nmetadata:\n  name: pay\nspec:\n  containers:\n  - image: pay:1\n",
        "infra/cfn.yml": "Resources:\n  Work:\n    Type: AWS::SQS::Queue\n",
        "infra/topic.yml": "kind: KafkaTopic\nmetadata:\n  name: orders\n",
        "api/openapi.yaml": "servers:\n  - url: https://pay.shop.test/v1\npaths:\n  /x:\n",
        "k8s/env.yaml": "env:\n  - name: PAY_URL\n    value: http://pay:80\n",
        "app/src/main/resources/application.yml": "spring:\n  application:\n    name: books\n",
        "release/all.yaml": "kind: Deployment\n",
    }
    frame = spark.createDataFrame(list(files.items()), "path string, text string")
    lines = corpus.split_lines(frame.filter(~corpus.is_excluded(F.col("path"))))
    assert lines.filter("path like 'release/%'").count() == 0
    units = corpus.deployables(lines)
    assert {(r.host, r.kind) for r in corpus.deployable_hosts(units).collect()} == {("shop", "svc"), ("cache", "cache"), ("pay", "svc")}
    services = corpus.named_by_deployment(corpus.service_names(lines), units)
    assert {(r.service_id, r.root_path) for r in services.filter("service_id is not null").collect()} >= {("shop", "svc/hipster"), ("pay", "svc/pay"), ("books", "app")}
    assert {(r.kind, r.tech, r.name) for r in signatures.iac_channels(lines).collect()} == {("queue", "sqs", "Work"), ("topic", "kafka", "orders")}
    assert [r.host for r in corpus.api_hosts(lines).collect()] == ["pay.shop.test"]
    assert ("PAY_URL", "http://pay:80") in {(r["var"], r.value) for r in corpus.address_hits(lines).collect()}


@pytest.mark.parametrize("host,object_,tag", [("http://orders.internal.svc.cluster.local/x", "orders", "CODE"), ("http://other.internal/x", "other", "INFERENCE"), ("https://api.bank.com/x", "api.bank.com", "CODE")])
def test_private_hosts_are_not_public_domains(spark, host, object_, tag):
    files = spark.createDataFrame([("a/go.mod", "module x/a\n"), ("a/x.py", f'requests.get("{host}")\n')], "path string, text string")
    services = corpus.service_names(corpus.split_lines(files)).select("service_id", "root_path")
    hosts = spark.createDataFrame([("orders", "orders", "svc")], "host string, id string, kind string")
    seen, _ = resolve.extract(files, services, hosts)
    assert {(r.object, r.tag) for r in seen.collect()} == {(object_, tag)}


def test_lock_files_open_no_gate(spark):
    files = spark.createDataFrame([("package-lock.json", '"kafkajs"\n'), ("pnpm-lock.yaml", "kafkajs\n"), ("go.sum", "sarama\n"), ("readme.md", "we like kafka\n")], "path string, text string")
    assert "kafka" not in {r.family for r in signatures.gated(corpus.split_lines(files)).collect()}


def test_wrappers_bindings_and_scopes(spark):
    files = spark.createDataFrame([("a/go.mod", "module x/a\nrequire amqp\n"), ("a/x.py", 'import pika\nemitEvent("paid")\nchannel.basic_consume("jobs", f)\nchannel.basic_consume("loose", f)\n'), ("b/go.mod", "module x/b\n"), ("b/y.py", 'channel.basic_consume("jobs", f)\n')], "path string, text string")
    services = corpus.service_names(corpus.split_lines(files)).select("service_id", "root_path")
    hosts = spark.createDataFrame([], "host string, id string, kind string")
    wrappers = spark.createDataFrame([("emitEvent", "rabbit", "pub")], "symbol string, family string, rel string")
    bindings = spark.createDataFrame([("jobs", "work")], "queue string, exchange string")
    seen, gaps = resolve.extract(files, services, hosts, wrappers, bindings, ("a/",))
    assert {(r.actor, r.rel, r.object, r.label) for r in seen.collect()} == {("a", "pub", "paid", "-"), ("a", "sub", "work", "queue=jobs"), ("a", "sub", "loose", "-")}
    assert "no binding for loose" in {r.detail for r in gaps.collect()}
