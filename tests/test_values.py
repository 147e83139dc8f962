"""Value flow, receiver typing and trees of keys: no call site is lost."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import consolidate, receivers, resolve, signatures, values
from weftgraph.sources import corpus, keys

FILES = {
    "compose.yml": """services:
    shop:
        build: ./shop
        environment:
            ORDERS_URL: http://orders:8080
            STOCK_HOST: stock
    orders:
        build:
            context: ./orders
        image: registry.test/orders:1
    stock-db:
        image: "postgres:16"
    broker:
        image: nats:2
""",
    "deploy/stock.yaml": """apiVersion: v1
kind: Service
metadata:
    name: stock
---
apiVersion: apps/v1
kind: Deployment
metadata:
    name: stock
spec:
    template:
        spec:
            containers:
            - name: main
              image: registry.test/stock:2
              env:
              - name: REPORT_TOPIC
                value: reports
""",
    "shop/package.json": '{"name": "@web/shop",\n "dependencies": {"kafkajs": "2", "amqplib": "1", "nats": "2"}}\n',
    "shop/src/main/resources/application.yml": "spring:\n  application:\n    name: shop\napp:\n  other: returns.created\n  channels:\n    refund: refund.v1\n",
    "shop/src/main/resources/application-prod.yml": "app:\n  other: returns.prod\n",
    "shop/src/Listen.java": """import org.springframework.kafka.annotation.KafkaListener;
class Listen {
  @KafkaListener(topics = "${app.topic:orders.created}")
  void a(String m) {}
  @KafkaListener(topics = "${app.other}")
  void b(String m) {}
  @KafkaListener(topics = "${app.missing}")
  void c(String m) {}
  @Value("${app.channels.refund}")
  private String refunds;
  private final KafkaTemplate<String, String> template;
  void d(Order o) {
    kafkaTemplate.send("orders.made", o.id(), o);
    streamBridge.send("orders.bridged", o);
    template.send(refunds, o);
    response.send("not.a.topic");
  }
}
""",
    "shop/src/call.ts": """import { connect } from "nats";
const BASE = process.env.ORDERS_ADDR ?? "http://orders:8080";
const ROOT = BASE;
const LINK = ROOT;
const DEEP = LINK;
const loopA = loopB;
const loopB = loopA;
await fetch(`${BASE}/orders/${id}`);
await fetch(DEEP + "/deep/" + order.id);
await fetch(loopA + "/x");
await axios.post(`${process.env.UNKNOWN_URL}/y`, body);
const nc = await connect();
nc.publish("n.lower", b);
channel.publish("shop.events", "made", b);
res.send("no.topic");
socket.send("no.topic2");
events.emit("no.topic3");
nc.publish(topicOf(order), b);
nc.publish("a sentence is no channel", b);
""",
    "shop/src/nest.ts": """import { ClientKafka } from "@nestjs/microservices";
class Orders {
  constructor(@Inject("K") private readonly client: ClientKafka) {}
  go() { this.client.emit("nest.orders", {}); }
}
""",
    "orders/go.mod": "module test.net/orders\n\nrequire github.com/aws/aws-sdk-go v1\nrequire google.golang.org/grpc v1\n",
    "orders/report.py": """import boto3
import kafka
ORDERS = os.environ["ORDERS_URL"]
requests.get(ORDERS + "/orders/1")
requests.get(f"{ORDERS}/items/{item}?x=1")
requests.get("http://" + os.environ["STOCK_HOST"] + ":80/level")
sns = boto3.client("sns")
sns.publish(TopicArn="arn:aws:sns:eu:1:alarms", Message=m)
sqs.send_message_batch(QueueUrl="https://sqs.eu.test/1/jobs", Entries=e)
p = KafkaProducer(bootstrap_servers=b)
p.send(os.environ["REPORT_TOPIC"], m)
p.send(SHARED, m)
orders_producer.produce("made.here", m)
""",
    "orders/a/one.py": 'SHARED = "shared.a"\n',
    "orders/b/two.py": 'SHARED = "shared.b"\n',
    "orders/stock.proto": "service Stock {\n  rpc GetLevel (Q) returns (L);\n  rpc Move (Q) returns (L);\n  rpc Unused (Q) returns (L);\n}\n",
    "orders/rpc.go": """package orders
func run(conn *grpc.ClientConn) {
	stub := pb.NewStockClient(conn)
	stub.GetLevel(ctx, q)
	stub.Move(ctx, q)
	stub.Other(ctx, q)
}
""",
    "stock/go.mod": "module test.net/stock\n",
    "stock/main.go": "package stock\nfunc main() {\n\tpb.RegisterStockServer(s, srv)\n}\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


@pytest.fixture(scope="module")
def extracted(spark, files):
    seen, gaps = resolve.extract(files)
    edges = consolidate.consolidate(seen).collect()
    return edges, gaps.collect()


def test_every_call_site_is_an_edge_a_gap_or_no_client(extracted):
    edges, gaps = extracted
    got = {(e.actor, e.rel, e.object, e.label, e.tag) for e in edges}
    assert got == {
        ("shop", "sub", "orders.created", "-", "CODE"),
        ("shop", "sub", "returns.created", "-", "CODE"),
        ("shop", "sub", "app.missing?", "-", "INFERENCE"),
        ("shop", "pub", "orders.made", "key=id", "CODE"),
        ("shop", "pub", "orders.bridged", "-", "CODE"),
        ("shop", "pub", "refund.v1", "-", "CODE"),
        ("shop", "pub", "n.lower", "-", "CODE"),
        ("shop", "pub", "shop.events", "-", "CODE"),
        ("shop", "pub", "nest.orders", "-", "CODE"),
        ("shop", "http", "orders", "ANY /orders/{id}", "CODE"),
        ("shop", "http", "orders", "ANY /deep/{id}", "CODE"),
        ("orders", "http", "stock", "GET /level", "CODE"),
        ("orders", "pub", "alarms", "-", "CODE"),
        ("orders", "pub", "jobs", "-", "CODE"),
        ("orders", "pub", "reports", "-", "CODE"),
        ("orders", "pub", "shared.a", "-", "INFERENCE"),
        ("orders", "pub", "made.here", "-", "CODE"),
        ("orders", "grpc", "stock", "GetLevel, Move", "CODE"),
    }
    told = {(g.subject, g.detail, g.line) for g in gaps}
    assert told == {
        ("shop", "unresolved http loopA", 10),
        ("shop", "unresolved http UNKNOWN_URL", 11),
        ("shop", "unresolved pub topicOf", 18),
        ("shop", "no channel name: pub a sentence is no channel", 19),
        ("shop/src/call.ts", "read but not declared: UNKNOWN_URL", 11),
    }


def test_receipts_and_notes_tell_the_whole_chain(extracted):
    edges, _ = extracted
    by = {(e.object, e.label): e for e in edges}
    lines = lambda e: {r.path: r.lines for r in e.receipts}
    assert lines(by["orders", "ANY /deep/{id}"]) == {"shop/src/call.ts": [2, 3, 4, 5, 9]}
    assert lines(by["refund.v1", "-"]) == {"shop/src/Listen.java": [9, 15], "shop/src/main/resources/application.yml": [7]}
    assert lines(by["reports", "-"]) == {"orders/report.py": [11], "deploy/stock.yaml": [18]}
    assert by["returns.created", "-"].note.startswith("base file; all values: returns.prod (shop/src/main/resources/application-prod.yml:2)")
    assert "shared.a (orders/a/one.py:1), shared.b (orders/b/two.py:1)" in by["shared.a", "-"].note


def test_services_hosts_and_nodes_are_declared_by_the_corpus(spark, files):
    services, hosts = resolve.surroundings(files)
    assert {tuple(r) for r in services.collect()} == {("shop", "shop"), ("orders", "orders"), ("stock", "stock")}
    assert {(r.host, r.kind) for r in hosts.collect()} == {("shop", "svc"), ("orders", "svc"), ("stock", "svc"), ("stock-db", "db")}
    infra = spark.createDataFrame([("infra/main.tf", 'resource "aws_sqs_queue" "work" {\n}\n')], "path string, text string")
    nodes = {(r.id, r.kind, r.path) for r in resolve.declared_nodes(files.unionByName(infra)).collect()}
    assert {("stock-db", "db", "compose.yml"), ("work", "queue", "infra/main.tf"), ("shop", "svc", "shop/src/main/resources/application.yml")} <= nodes
    assert not any(n[0] == "broker" for n in nodes)


def test_receivers_have_the_family_of_their_client(spark):
    text = """KafkaTemplate<String, Order> kafka;
constructor(private readonly bus: ClientProxy) {}
func f(w *kafka.Writer) {
ch, err := conn.Channel()
producer = AIOKafkaProducer(loop=loop)
private final RabbitTemplate rabbit;
Channel channel = connection.createChannel();
const q = new Queue("mail");
return new KafkaTemplate<>(factory);
const other = build();
"""
    lines = corpus.split_lines(spark.createDataFrame([("a.txt", text)], "path string, text string"))
    got = {(r.name, r.family) for r in receivers.receivers(lines).collect()}
    assert got == {("kafka", "kafka"), ("bus", "kafka"), ("w", "kafka"), ("ch", "rabbit"), ("producer", "kafka"), ("rabbit", "rabbit"), ("channel", "rabbit"), ("q", "jobs")}


EXPRESSIONS = {
    '"lit"': [("text", "lit", None)],
    'BASE + "/orders/" + id': [("name", "BASE", None), ("text", "/orders/", None), ("name", "id", None)],
    "`${BASE}/orders/${order.id}`": [("name", "BASE", None), ("text", "/orders/", None), ("name", "order.id", None)],
    'f"{ORDERS_URL}/orders/1"': [("name", "ORDERS_URL", None), ("text", "/orders/1", None)],
    '"${app.topic:orders.created}"': [("key", "app.topic", "orders.created")],
    '"http://${HOST:-h}:80"': [("text", "http://", None), ("key", "HOST", "h"), ("text", ":80", None)],
    'process.env.ORDERS_URL ?? "http://orders:8080"': [("env", "ORDERS_URL", "http://orders:8080")],
    'os.environ["A"]': [("env", "A", None)],
    'os.getenv("K", "v")': [("env", "K", "v")],
    "`${process.env.HOST || 'h'}/x`": [("env", "HOST", "h"), ("text", "/x", None)],
    "topicFor(tenant)": [("call", "topicFor", None)],
    "a ? b : c": [("call", "a ? b : c", None)],
    "'it' + x": [("text", "it", None), ("name", "x", None)],
    "": [],
    None: [],
}


def test_parts_of_expressions(spark):
    df = spark.createDataFrame([(e,) for e in EXPRESSIONS], "e string").select("e", values.parts_of(F.col("e")).alias("p"))
    assert {r.e: [(p.kind, p.text, p.fallback) for p in r.p] for r in df.collect()} == EXPRESSIONS


def test_chains_and_cycles(spark):
    chain = "".join(f"V{i} = V{i + 1}\n" for i in range(40)) + 'V40 = "end"\nA = B\nB = C\nC = A\nX = X\n' + "".join(f"D{i} = D{i + 1} + D{i + 1}\n" for i in range(12)) + 'D12 = "d"\n'
    lines = corpus.split_lines(spark.createDataFrame([("a.py", chain)], "path string, text string"))
    code = values.definitions(lines)
    trees = keys.key_trees(spark.createDataFrame([], "path string, text string"))
    sites = spark.createDataFrame([(i, "a.py", 99, e) for i, e in enumerate(["V0", "A", "X", "D9", "D0", "nothing"])], "id bigint, path string, line int, e string")
    done = values.flow(sites.select("id", "path", "line", values.parts_of(F.col("e")).alias("parts")), code, values.config_definitions(trees))
    got = {r.id: r for r in done.withColumn("value", values.value_of(F.col("parts"))).collect()}
    assert got[0].value == "end" and len(got[0].parts[0].places) == 41
    assert got[1].parts[0].kind == "name" and got[2].value == "{X}" and got[5].value == "{nothing}"
    assert got[3].value == "d" * 8 and got[4].parts[0].kind == "call"


YAML = """# c
app:
  other: returns.created
  list:
    - a
    - b: 1
      c: "x # y"
  flow: [one, {k: v, z: [1, 2]}]
env:
- name: BASKET_URL
  value: "http://basket:8080"   # here
text: |
  not: a key
services:
    web:
        environment:
            - ORDERS_URL=http://orders:8080
'quoted': 'it''s'
url: http://x:80/a#b
---
app:
  third: z
"""
TREES = {
    "a.yml": (YAML, {(3, 0, "app.other", "returns.created"), (5, 0, "app.list.0", "a"), (6, 0, "app.list.1.b", "1"), (7, 0, "app.list.1.c", "x # y"), (8, 0, "app.flow.0", "one"), (8, 0, "app.flow.1.k", "v"), (8, 0, "app.flow.1.z.0", "1"), (8, 0, "app.flow.1.z.1", "2"), (10, 0, "env.0.name", "BASKET_URL"), (11, 0, "env.0.value", "http://basket:8080"), (11, 0, "env.BASKET_URL", "http://basket:8080"), (17, 0, "services.web.environment.0", "ORDERS_URL=http://orders:8080"), (17, 0, "services.web.environment.ORDERS_URL", "http://orders:8080"), (18, 0, "quoted", "it's"), (19, 0, "url", "http://x:80/a#b"), (22, 1, "app.third", "z")}),
    "b.json": ('{"a": {"b": [1, {"c": "x,y"}]},\n "d": "e",\n "f": {}}', {(1, 0, "a.b.0", "1"), (1, 0, "a.b.1.c", "x,y"), (2, 0, "d", "e")}),
    "c.tf": ('resource "aws_sqs_queue" "work" {\n  name = "work-q"\n  tags = {\n    team = "a"\n  }\n  list = ["a", "b"]\n}\nvariable "topic" { default = "orders" }\n', {(2, 0, "resource.aws_sqs_queue.work.name", "work-q"), (4, 0, "resource.aws_sqs_queue.work.tags.team", "a"), (6, 0, "resource.aws_sqs_queue.work.list.0", "a"), (6, 0, "resource.aws_sqs_queue.work.list.1", "b"), (8, 0, "variable.topic.default", "orders"), (8, 0, "var.topic", "orders")}),
    "d.toml": ('[a.b]\nc = "x" # y\nd.e = [1, 2]\n[[p]]\nn = 1\n[[p]]\nn = 2\n', {(2, 0, "a.b.c", "x"), (3, 0, "a.b.d.e.0", "1"), (3, 0, "a.b.d.e.1", "2"), (5, 0, "p.0.n", "1"), (7, 0, "p.1.n", "2")}),
    "e/.env.local": ('# c\nA=b\nexport Z="q r"\nx.y = http://h:1/p#q\n', {(2, 0, "A", "b"), (3, 0, "Z", "q r"), (4, 0, "x.y", "http://h:1/p#q")}),
    "broken.json": ("]}{ : ,,", set()),
    "broken.yml": ("- : [\n  {a\n\t-", None),
}


def test_trees_of_keys(spark):
    files = spark.createDataFrame([*((p, t) for p, (t, _) in TREES.items()), ("n.yml", None), ("e.yml", ""), ("x.py", "a = 1")], "path string, text string")
    got = {}
    for r in keys.key_trees(files).collect():
        got.setdefault(r.path, set()).add((r.line, r.doc, r.key, r.value))
    for path, (_, expected) in TREES.items():
        if expected is not None:
            assert got.get(path, set()) == expected, path
    assert keys.key_trees(files.limit(0)).count() == 0


def test_signature_alternatives(spark):
    """One line of each idiom that the families have to find."""
    idioms = {
        ("kafka", "pub"): ['kafkaTemplate.send("t", v);', 'ordersProducer.send({ topic: "t" })', 'p.produce("t", v)', 'streamBridge.send("t", v)'],
        ("kafka", "sub"): ['@KafkaListener(topics = "t")', "consumer.Consume(ctx, topics, h)", 'builder.stream("t")', 'app.topic("t")', 'c.subscribe(List.of("t"))'],
        ("rabbit", "sub"): ["@QueueBinding(value = q)", 'bindQueue("q", "e", "rk")'],
        ("aws", "pub"): ["sqs.sendMessage({ QueueUrl: u })", "sqs.send_message_batch(QueueUrl=u)"],
        ("aws", "sub"): ["sqs.receiveMessage({ QueueUrl: u })"],
        ("azure", "pub"): ["sender.send_messages(m)"],
        ("jobs", "pub"): ["send_mail.delay(1)", "rdb.XAdd(ctx, a)"],
        ("jobs", "sub"): ["rdb.XReadGroup(ctx, a)"],
        ("grpc", "grpc"): ['grpc.insecure_channel("h:1")', 'grpc.Dial("h:1")'],
    }
    rows = [(f"{f}{r}{i}.txt", t) for (f, r), ts in idioms.items() for i, t in enumerate(ts)]
    hits = signatures.sweep(corpus.split_lines(spark.createDataFrame(rows, "path string, text string"))).collect()
    found = {(h.family, h.rel, h.text) for h in hits}
    assert {(f, r, t) for (f, r), ts in idioms.items() for t in ts} <= found


def test_routes_are_matched_by_segment(spark):
    routes = spark.createDataFrame([("GET", "/users/{name}", "users"), ("ANY", "/orders/{id}", "orders"), ("GET", "/orders/latest", "recent"), ("ANY", "/a/{x}/c", "left"), ("ANY", "/a/b/{y}", "far"), ("GET", "/twice/{x}", "one"), ("GET", "/twice/:y", "two"), ("ANY", "/", "home")], "method string, template string, service_id string")
    rows = {"/users/bob": ("GET", "users"), "/orders/latest": ("ANY", "recent"), "/orders/{id}": ("POST", "orders"), "/a/b/c": ("GET", "far"), "/twice/1": ("GET", None), "/none": ("GET", None), "/users/bob/x": ("GET", None), "/": (None, None), "/users/post": ("POST", None)}
    calls = spark.createDataFrame([("f", i, m, t) for i, (t, (m, _)) in enumerate(rows.items())], "path string, line int, method string, template string")
    got = {r.template: (r.service_id if r.outcome == "INFERENCE" else None) for r in resolve.route_matches(calls, routes).collect()}
    assert got == {t: s for t, (_, s) in rows.items()} | {"/": "home"}


def test_a_second_reader_objects(spark):
    from weftgraph.operators import checks
    from weftgraph.schema import EDGES

    lines = spark.createDataFrame([("a.py", 1, 'send("orders")'), ("a.py", 2, "send(TOPIC)"), ("b.py", 7, "  }")], "path string, line int, text string")
    edges = [
        ("a", "pub", "orders", "-", "CODE", [("a.py", [1])], None),
        ("a", "pub", "paid", "-", "CODE", [("a.py", [2])], None),
        ("a", "pub", "orders", "k", "CODE", [("a.py", [1]), ("b.py", [7])], None),
        ("a", "sub", "x?", "-", "INFERENCE", [("a.py", [2])], "guess"),
        ("a", "sub", "y?", "-", "INFERENCE", [("a.py", [2])], "confirm: y"),
        ("a", "sub", "y?", "-", "INFERENCE", [("a.py", [1])], "confirm: y"),
    ]
    found = checks.verifier_violations(spark.createDataFrame(edges, EDGES), lines).collect()
    assert {(r.rule, r.object, r.label) for r in found} == {("receipt", "paid", "-"), ("definition", "paid", "-"), ("receipt", "orders", "k"), ("note", "x?", "-"), ("duplicate", "y?", "-")}
    drawn = spark.createDataFrame([("flowchart LR\n  s_a --> t_b\n  s_a -.-> t_c\n",)], "mermaid string")
    xml = lambda n: spark.createDataFrame([("<root>" + '<mxCell id="e" edge="1" source="a"/>' * n + "</root>",)], "xml string")
    assert checks.drawn_counts(drawn, xml(2)).count() == 0
    assert [r.message for r in checks.drawn_counts(drawn, xml(1)).collect()] == ["2 edges in Mermaid, 1 in draw.io"]
