"""From source text to edges, on a small polyglot repository of our own."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import consolidate, resolve, signatures
from weftgraph.sources import corpus

FILES = {
    "compose.yml": """services:
  basket:
    build: ./basket
    environment:
      PAID_TOPIC: paid
      ORDER_DSN: postgres://app:hunter2@order-db:5432/orders
    depends_on:
      - order-db
      - broker
  courier:
    build: ./courier
    environment:
      BASKET_URL: http://basket:8080
      SHIPPED_TOPIC: shipped
  order-db:
    image: postgres:16
  broker:
    image: confluentinc/cp-kafka:7.5
""",
    "basket/go.mod": "module example.net/shop/basket\n\nrequire github.com/segmentio/kafka-go v0.4\n",
    "basket/pay.go": """package basket

func pay(w *kafka.Writer) {
	msg := kafka.Message{
		Topic: "paid",
		Key:   []byte(orderID),
	}
	_ = msg
}

func db() {
	sql.Open("pgx", "postgres://app:hunter2@order-db:5432/orders")
}
""",
    "courier/package.json": '{\n  "name": "@shop/courier",\n  "dependencies": {"kafkajs": "2"}\n}\n',
    "courier/src/run.ts": """const base = process.env.BASKET_URL || "http://basket:8080";
const shippedTopic = "shipped";
await consumer.subscribe({
  topic: "paid",
});
await producer.send({ topic: "shipped", messages });
export async function order(id) {
  return fetch(`http://basket:8080/orders/${id}`);
}
await fetch("https://api.postline.io/v1/send");
await fetch("http://localhost:3000/health");
await producer.send(unknownTopic);
""",
    "courier/test/run.test.ts": 'await producer.send({ topic: "only-in-tests" });\n',
    "ledger/pyproject.toml": '[project]\nname = "ledger"\ndependencies = ["kafka-python"]\n',
    "ledger/in.py": """import os
TOPIC = os.getenv("PAID_TOPIC", "paid")
consumer = KafkaConsumer(TOPIC, group_id="ledger")
stub = QuotesStub(channel)
""",
    "ledger/quotes.proto": "service Quotes {\n}\n",
    "node_modules/x/index.js": 'producer.send({ topic: "never" });\n',
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


@pytest.fixture(scope="module")
def lines(files):
    return corpus.split_lines(files.filter(~corpus.is_excluded(F.col("path"))))


def test_sources(spark, files, lines):
    assert {(r.path, r.ecosystem) for r in corpus.manifests(files).collect()} == {("compose.yml", "compose"), ("basket/go.mod", "go"), ("courier/package.json", "npm"), ("ledger/pyproject.toml", "python")}
    assert {(r.service_id, r.root_path, r.tech) for r in corpus.service_names(lines).collect()} == {("basket", "basket", "go"), ("courier", "courier", "npm"), ("ledger", "ledger", "python")}
    units = {r.name: r for r in corpus.compose_services(lines).collect()}
    assert units["order-db"].image == "postgres:16" and units["basket"].build == "./basket" and units["basket"].depends_on == ["broker", "order-db"]
    assert {(e["var"], e["value"]) for e in units["courier"].environment} == {("BASKET_URL", "http://basket:8080"), ("SHIPPED_TOPIC", "shipped")}
    assert [r.name for r in corpus.contracts(lines).collect()] == ["Quotes"]
    assert {r["var"] for r in corpus.address_hits(lines).collect()} >= {"PAID_TOPIC", "ORDER_DSN", "BASKET_URL"}
    services = corpus.service_names(lines).select("service_id", "root_path")
    owned = {r.path: r.service_id for r in corpus.owners(files, services).collect()}
    assert owned["courier/src/run.ts"] == "courier" and owned["compose.yml"] is None


def test_lines_of_files_with_and_without_a_last_break(spark):
    got = corpus.split_lines(spark.createDataFrame([("a", "x\ny\n"), ("b", "x\n\ny"), ("c", ""), ("d", None)], "path string, text string"))
    assert {r.path: r.n_lines for r in corpus.line_counts(got).collect()} == {"a": 2, "b": 3}


def test_repository_is_read_without_its_excluded_folders(spark, tmp_path):
    for path, text in FILES.items():
        p = tmp_path / "repo" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.path: r.text for r in corpus.read_repository(spark, f"{tmp_path}/repo").collect()}
    assert got == {k: v for k, v in FILES.items() if not k.startswith("node_modules")}


def test_edges_of_the_repository(spark, files, lines):
    services = corpus.service_names(lines).select("service_id", "root_path")
    hosts = spark.createDataFrame([("basket", "basket", "svc"), ("courier", "courier", "svc"), ("order-db", "order-db", "db")], "host string, id string, kind string")
    seen, gaps = resolve.extract(files, services, hosts)
    edges = consolidate.consolidate(seen).collect()
    got = {(e.actor, e.rel, e.object, e.label, e.tag) for e in edges}
    assert {
        ("basket", "pub", "paid", "key=orderID", "CODE"),
        ("basket", "uses", "order-db", "sql", "CODE"),
        ("courier", "sub", "paid", "-", "CODE"),
        ("courier", "pub", "shipped", "-", "CODE"),
        ("courier", "http", "api.postline.io", "ANY /v1/send", "CODE"),
        ("courier", "pub", "unknownTopic?", "-", "INFERENCE"),
        ("ledger", "sub", "paid", "group=ledger", "CODE"),
        ("ledger", "grpc", "Quotes", "-", "INFERENCE"),
    } <= got
    assert any(x[:3] == ("courier", "http", "basket") for x in got)
    assert not any("localhost" in x[2] or x[2] in ("never", "only-in-tests") for x in got)
    assert not any("hunter2" in str(e) for e in edges)
    first = {(e.actor, e.rel, e.object): e.receipts[0] for e in edges}
    assert (first["basket", "pub", "paid"].path, first["basket", "pub", "paid"]["lines"]) == ("basket/pay.go", [4, 5])
    assert gaps.columns == ["subject", "detail", "path", "line"]


def test_gates_bindings_and_infrastructure(spark, lines):
    families = {r.family for r in signatures.gated(lines).collect()}
    assert "kafka" in families and "http" in families and "nats" not in families
    config = spark.createDataFrame([("a", 1, "spring.cloud.stream.bindings.orders-out-0.destination", "orders"), ("a", 2, "spring.cloud.stream.bindings.orders-in-0.destination", "orders"), ("a", 3, "spring.cloud.stream.bindings.x.destination", "y")], "path string, line int, key string, value string")
    assert {(r.rel, r.channel) for r in signatures.stream_bindings(config).collect()} == {("pub", "orders"), ("sub", "orders")}
    tf = 'resource "aws_sns_topic" "events" {\n}\nresource "aws_sqs_queue" "work" {\n}\nresource "aws_sns_topic_subscription" "s" {\n  topic_arn = aws_sns_topic.events.arn\n  endpoint  = aws_sqs_queue.work.arn\n}\n'
    infra = corpus.split_lines(spark.createDataFrame([("infra/main.tf", tf)], "path string, text string"))
    assert {(r.kind, r.name) for r in signatures.iac_channels(infra).collect()} == {("topic", "events"), ("queue", "work")}
    assert [(r.topic, r.queue) for r in signatures.iac_subscriptions(infra).collect()] == [("events", "work")]


def test_contracts_routes_and_exchanges(spark):
    stubs = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    reg = spark.createDataFrame([("A", "svc-a")], "name string, service_id string")
    hint = spark.createDataFrame([("B", "svc-b")], "name string, service_id string")
    assert {tuple(r) for r in resolve.contract_tag(stubs, reg, hint).collect()} == {("A", "svc-a", "svc", "CODE"), ("B", "svc-b", "svc", "INFERENCE"), ("C", "C", "ref", "INFERENCE")}
    paths = spark.createDataFrame([("p", 1, "/orders/{id}"), ("p", 2, "/none")], "path string, line int, template string")
    routes = spark.createDataFrame([("/orders/{id}", "basket")], "template string, service_id string")
    assert {r.line: r.outcome for r in resolve.matched_routes(paths, routes).collect()} == {1: "INFERENCE", 2: "GAP"}
    queues = spark.createDataFrame([("a", "q1"), ("a", "q2")], "actor string, queue string")
    bound = spark.createDataFrame([("q1", "orders")], "queue string, exchange string")
    assert {(r.object, r.label, r.gap) for r in resolve.bound_exchange(queues, bound).collect()} == {("orders", "queue=q1", None), ("q2", "-", "no binding for q2")}


def test_routes_are_found_in_several_frameworks(spark):
    text = '@GetMapping("/orders/{orderId}")\napp.post("/pay/:id", f)\n@app.route("/x")\nmux.HandleFunc("GET /y/{id}", h)\n'
    found = corpus.routes(corpus.split_lines(spark.createDataFrame([("a.txt", text)], "path string, text string")))
    assert {(r.method, r.template) for r in found.collect()} == {("GET", "/orders/{id}"), ("POST", "/pay/{id}"), ("ANY", "/x"), ("GET", "/y/{id}")}
