"""Text form, integrity, lenses and rules on a small ledger of our own."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import checks, consolidate, graph, review
from weftgraph.plans import render
from weftgraph.schema import EDGE_KEY
from weftgraph.sources import ledger as L

LEDGER = """# topology.ledger v2 · shop · abc1234 · all
N basket svc go | basket/go.mod:1
N courier svc typescript | courier/package.json:2
N ledger svc python | ledger/pyproject.toml:2
N mail.example.net ext http | courier/src/mail.ts:4
N order-db db postgres | compose.yml:9
N paid topic kafka | basket/pay.go:21
N quotes ref grpc | ledger/quote.py:7
N shipped topic kafka | courier/src/run.ts:30
E basket pub paid | key=orderId | CODE | basket/pay.go:21,22,14; compose.yml:3
E basket uses order-db | sql | CODE | basket/db.go:5; compose.yml:9
E courier http basket | GET /orders/{id} | CODE | courier/src/api.ts:3,1; compose.yml:12
E courier http mail.example.net | POST /send | CODE | courier/src/mail.ts:4
E courier pub shipped | - | CODE | courier/src/run.ts:30
E courier sub paid | group=courier | CODE | courier/src/run.ts:12
E ledger grpc quotes | - | INFERENCE | ledger/quote.py:7 | confirm: where quotes is served
E ledger http basket | GET /orders/{id} | CODE | ledger/api.py:8; compose.yml:20
E ledger sub paid | group=ledger | CODE | ledger/in.py:13
G quotes | no contract in scope | ledger/quote.py:7
"""
COUNTS = [("basket/go.mod", 5), ("courier/package.json", 9), ("ledger/pyproject.toml", 4), ("courier/src/mail.ts", 9), ("compose.yml", 40), ("basket/pay.go", 30), ("ledger/quote.py", 9), ("courier/src/run.ts", 44), ("basket/db.go", 9), ("courier/src/api.ts", 9), ("ledger/api.py", 9), ("ledger/in.py", 20)]


def load(spark, text):
    rows = [(i, v) for i, v in enumerate(text.rstrip("\n").split("\n"), 1)]
    raw = spark.createDataFrame(rows, "line_no int, value string")
    return raw, L.parse_nodes(raw), L.parse_edges(raw), L.parse_gaps(raw)


@pytest.fixture(scope="module")
def shop(spark):
    return load(spark, LEDGER)


def found(spark, text):
    raw, nodes, edges, _ = load(spark, text)
    counts = spark.createDataFrame(COUNTS, "path string, n_lines int")
    return {r.check_id for r in checks.violations(raw, nodes, edges, L.raw_receipts(raw), counts).collect()}


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def start(spark, name):
    return spark.createDataFrame([(name,)], "id string")


def test_text_form_round_trips(spark, shop, tmp_path):
    _, nodes, edges, gaps = shop
    lines = L.ledger_lines(nodes, edges.withColumn("note", F.nullif("note", F.lit(""))), gaps)
    got = [r.line for r in lines.orderBy("block", "line").collect()]
    assert "\n".join(got) + "\n" == LEDGER.split("\n", 1)[1]
    path = L.write_ledger(nodes, edges, gaps, f"file://{tmp_path}", "shop.ledger", LEDGER.split("\n", 1)[0])
    assert spark.read.text(path).count() == 19
    with pytest.raises(ValueError):
        L.inside("/out", "/out/../etc/passwd")
    header = L.parse_header(shop[0]).first()
    assert (header.version, header.repo, header["commit"], header.scopes) == ("v2", "shop", "abc1234", ["all"])


def test_a_file_is_read_by_lines(spark, tmp_path):
    (tmp_path / "x.ledger").write_text(LEDGER)
    assert L.read_raw(spark, f"file://{tmp_path}/x.ledger").count() == 19


def test_a_sound_ledger_has_no_violation(spark):
    assert found(spark, LEDGER) == set()


@pytest.mark.parametrize(
    "check,old,new",
    [
        ("CHK-1", "# topology.ledger v2", "# something"),
        ("CHK-2", "G quotes | no contract in scope | ledger/quote.py:7\n", "G quotes | no contract in scope | ledger/quote.py:7\nN z svc go | compose.yml:1\n"),
        ("CHK-3", "N basket svc go | basket/go.mod:1\n", "N zz svc go | basket/go.mod:1\nN basket svc go | basket/go.mod:1\n"),
        ("CHK-4", "N order-db db", "N order-db table"),
        ("CHK-5", "N paid topic kafka | basket/pay.go:21\n", "N paid topic kafka | basket/pay.go:21\nN paid topic kafka | basket/pay.go:22\n"),
        ("CHK-6", "basket uses order-db", "basket reads order-db"),
        ("CHK-6", "| CODE | basket/db.go", "| SURE | basket/db.go"),
        ("CHK-7", " | confirm: where quotes is served", ""),
        ("CHK-8", " | basket/go.mod:1", ""),
        ("CHK-9", "basket/go.mod:1", "basket/go.mod:one"),
        ("CHK-10", "basket/go.mod:1", "basket/none.mod:1"),
        ("CHK-11", "basket/go.mod:1", "basket/go.mod:99"),
        ("CHK-12", "N shipped topic kafka | courier/src/run.ts:30\n", ""),
    ],
)
def test_each_violation_is_found(spark, check, old, new):
    assert old in LEDGER
    assert check in found(spark, LEDGER.replace(old, new, 1))


def test_lenses(spark, shop):
    _, nodes, edges, _ = shop
    assert ids(graph.focus(edges, start(spark, "ledger")), "object") == {"quotes", "basket", "paid"}
    assert graph.focus(edges, start(spark, "ledger")).count() == 4  # with the producer of what it reads
    assert {(r.node, r.ring) for r in graph.impact(edges, start(spark, "basket")).collect()} == {("courier", 1), ("ledger", 1)}
    assert {(r.node, r.ring) for r in graph.impact(edges, start(spark, "paid")).collect()} == {("courier", 1), ("ledger", 1)}
    assert {(r.node, r.ring) for r in graph.deps(edges, start(spark, "courier")).collect()} == {("basket", 1), ("mail.example.net", 1), ("order-db", 2)}
    assert {(r.actor, r.rel, r.object) for r in graph.lineage(edges, start(spark, "paid")).collect()} == {("basket", "pub", "paid"), ("courier", "sub", "paid"), ("ledger", "sub", "paid"), ("courier", "pub", "shipped"), ("courier", "http", "basket"), ("ledger", "http", "basket")}
    paths = graph.simple_paths(edges, start(spark, "basket"), start(spark, "mail.example.net")).collect()
    assert [r.nodes for r in paths] == [["basket", "paid", "courier", "mail.example.net"]]
    assert graph.data(nodes, edges).select("object", "users", "shared").first()[:] == ("order-db", 1, False)
    row = graph.stats(edges).first()
    assert (row.nodes, row.edges, row.code, row.inferred) == (8, 9, 8, 1)


def test_properties_of_lenses(spark, shop):
    _, nodes, edges, _ = shop
    all_ids = [r.id for r in nodes.collect()]
    forward = {a: {(r.node, r.ring) for r in graph.deps(edges, start(spark, a)).collect()} for a in ("basket", "courier", "ledger")}
    for b in ("basket", "courier"):
        back = {r.node: r.ring for r in graph.impact(edges, start(spark, b)).collect()}
        for a in forward:
            assert (back.get(a) in {ring for n, ring in forward[a] if n == b}) == (a in back)
    assert graph.diff(edges, edges).count() == 0
    assert checks.outside_ledger(graph.focus(edges, start(spark, "basket")), edges).count() == 0
    assert set(all_ids) == ids(graph.endpoints(nodes, edges))


def test_diff_pairs_relabelled_edges(spark, shop):
    edges = shop[2]
    new = edges.withColumn("label", F.when(F.col("rel") == "uses", "nosql").otherwise(F.col("label"))).filter("rel <> 'grpc'")
    assert {(r.object, r.old_label, r.new_label, r.change) for r in graph.diff(edges, new).collect()} == {("order-db", "sql", "nosql", "relabelled"), ("quotes", "-", None, "removed")}


def test_rules(spark, shop):
    _, nodes, edges, _ = shop
    got = {(r.id, r.finding) for r in review.findings(nodes, edges).collect()}
    assert {x[0] for x in got} == {"T2", "T4", "T8", "T11"}
    assert sum(x[0] == "T2" for x in got) == 2
    assert ("T4", "shipped has no consumer") in got and ("T11", "quotes has no contract in scope") in got
    assert ids(review.warned(review.findings(nodes, edges))) == {"basket", "courier", "ledger"}
    row = review.health(nodes, edges, review.findings(nodes, edges)).first()
    assert (row.services, row.referenced, row.edges, row.code_percent, row.sync_depth, row.med) == (3, 1, 9, 89, 1, 2)
    assert "3 services (+1 referenced) · 9 edges (89% CODE)" in review.health_line(review.health(nodes, edges, review.findings(nodes, edges))).first().line


def test_cycles_are_found_once(spark):
    rows = [("a", "http", "b"), ("b", "grpc", "c"), ("c", "http", "a"), ("b", "http", "a"), ("c", "ws", "b")]
    edges = spark.createDataFrame([(*r, "-", "CODE") for r in rows], "actor string, rel string, object string, label string, tag string")
    assert sorted(tuple(r.nodes) for r in graph.cycles(edges).collect()) == [("a", "b"), ("a", "b", "c")]


def test_consolidation_is_idempotent_and_orders_receipts(spark):
    rows = [("a", "pub", "t", "-", "INFERENCE", "z", 1, "note"), ("a", "pub", "t", "-", "CODE", "b", 9, None), ("a", "pub", "t", "-", "CODE", "b", 2, None), ("a", "pub", "t", "-", "CODE", "a", 5, None), ("a", "pub", "t", "-", "CODE", "a", 5, None)]
    seen = spark.createDataFrame(rows, "actor string, rel string, object string, label string, tag string, path string, line int, note string")
    once = consolidate.consolidate(seen)
    row = once.first()
    assert row.tag == "CODE" and row.note is None
    assert [(r.path, r["lines"]) for r in row.receipts] == [("a", [5]), ("b", [2, 9]), ("z", [1])]
    assert consolidate.merge(once, once).select(*EDGE_KEY, "tag", T.receipt_text(F.col("receipts"))).collect()[0][:5] == once.select(*EDGE_KEY, "tag").first()[:]


def test_refresh_drops_what_changed(spark, shop):
    edges = shop[2]
    changed = spark.createDataFrame([("compose.yml",)], "path string")
    assert consolidate.invalidate(edges, changed).count() == 9
    assert consolidate.invalidate(edges, changed, strict=True).count() == 5
    assert consolidate.invalidate(edges, spark.createDataFrame([("courier/src/run.ts",)], "path string")).count() == 7
    header = L.parse_header(shop[0])
    assert consolidate.is_fresh(header, "abc1234", changed.limit(0)).first().fresh
    assert not consolidate.is_fresh(header, "abc1234", changed).first().fresh


def test_labels_fold_and_dep_edges_give_way(spark):
    rows = [("a", "http", "b", "-", "CODE", "x", 1, None), ("a", "http", "b", "GET /", "CODE", "x", 2, None), ("a", "dep", "b", "-", "CODE", "c", 3, None), ("a", "dep", "d", "-", "CODE", "c", 4, None)]
    seen = spark.createDataFrame(rows, "actor string, rel string, object string, label string, tag string, path string, line int, note string")
    edges = consolidate.consolidate(consolidate.fold_labels(seen))
    assert {(r.rel, r.object, r.label) for r in edges.collect()} == {("http", "b", "GET /"), ("dep", "b", "-"), ("dep", "d", "-")}
    kept = {(r.rel, r.object): T and r.receipts for r in consolidate.subsume_dep(edges).collect()}
    assert set(kept) == {("http", "b"), ("dep", "d")} and [x.path for x in kept["http", "b"]] == ["x", "c"]


def test_diagrams(spark, shop):
    _, nodes, edges, gaps = shop
    text = render.flowchart(nodes, edges).first().mermaid
    assert text.startswith("flowchart LR\n") and text.count("-->") == 8 and text.count("-.->") == 1
    assert 's_quotes["quotes ?"]' in text and 't_paid{{"paid"}}' in text and "class d_order_db db" in text
    xml = render.drawio(nodes, edges).first().xml
    import xml.etree.ElementTree as ET

    root = ET.fromstring(xml)
    cells = [c.get("id") for c in root.iter() if c.get("id")]
    assert len(cells) == len(set(cells)) and {"0", "1", "n1", "e9"} <= set(cells)
    ends = [(c.get("source"), c.get("target")) for c in root.iter("mxCell") if c.get("edge")]
    assert len(ends) == 9 and all(a in cells and b in cells for a, b in ends)
    view = render.markdown("All", nodes, edges).first().view
    assert "8 nodes · 9 edges (8 CODE / 1 inferred)" in view and "| basket → paid · key=orderId | CODE |" in view
    focus = graph.focus(edges, start(spark, "ledger"))
    hidden = render.not_shown(graph.endpoints(nodes, focus), focus, edges, gaps).collect()
    assert {r.what for r in hidden} == {"gap", "hidden"}
    steps = spark.createDataFrame([(1, "courier", "basket", "GET /", "CODE"), (2, "basket", "x", "-", "INFERENCE")], "step int, src string, dst string, label string, tag string")
    assert render.sequence(steps).first().mermaid.split("\n")[-2:] == ["  courier->>basket: GET /", "  basket-->>x: -"]


def test_empty_ledger_gives_empty_results(spark, shop):
    _, nodes, edges, _ = shop
    none = edges.limit(0)
    assert graph.impact(none, start(spark, "a")).count() == 0
    assert review.findings(nodes.limit(0), none).count() == 0
    assert consolidate.merge(none, none).count() == 0
    assert graph.diff(none, none).count() == 0


def test_scalars(spark):
    row = spark.createDataFrame([("GET", "/orders/42/items/7?x=1", "https://user:pw@db.internal:5432/x", "orders.topicName")], "m string, p string, u string, k string")
    got = row.select(T.http_label(F.col("m"), F.col("p")), T.host(F.col("u")), T.engine(F.lit("postgres://u:secret@h/x")), F.array_join(T.spellings(F.col("k")), ","), T.elide(F.lit("x" * 40)), T.store_kind(F.lit("docker.io/library/redis:7")), T.is_broker(F.lit("confluentinc/cp-kafka:7.5")), T.slug(F.lit("A b/C"))).first()
    assert got[:] == ("GET /orders/{id}/items/{id}", "db.internal", "sql", "orders.topicName,ORDERS_TOPIC_NAME,orders.topic.name,topicName,orders.topic_name", "x" * 14 + "…" + "x" * 13, "cache", True, "a-b-c")
    names = spark.createDataFrame([("orders.created", True), ("42", False), ("true", False), ("OrderCreated", False), ("a b", False), ("/x", False)], "n string, ok boolean")
    assert all(r.ok == r.got for r in names.withColumn("got", T.valid_channel(F.col("n"))).collect())
