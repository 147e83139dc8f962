"""The driver's tables as a ledger: nations are services, brands topics, regions databases."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.consolidate import consolidate
from ..operators.consolidate import edge_tags as tags
from ..schema import RECEIPTS
from ..sources.shared import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nations, brand, type and segment that they tie together."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    svc = lambda key: F.concat(F.lit("svc-"), F.col(key).cast("string"))
    return joined.select(
        svc("c_nationkey").alias("c"),
        svc("s_nationkey").alias("s"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("c_mktsegment").alias("segment"),
        F.col("l_returnflag").alias("flag"),
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("path"),
        F.col("l_linenumber").cast("int").alias("line"),
    )


def kept_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sightings() over a base that is written once, for those who need them twice: a row a line item, not one for each fact."""
    return sightings(spark, sf_dir, kept(base(spark, sf_dir)))


def sightings(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """One row per fact that a line item (``items``: base()) shows; the line items are read once."""
    fact = lambda actor, rel, object_, label, tag="CODE", note=None: F.struct(F.col(actor).alias("actor"), F.lit(rel).alias("rel"), object_.alias("object"), label.alias("label"), F.lit(tag).alias("tag"), (F.lit(None).cast("string") if note is None else note).alias("note"))
    none = F.lit(None).cast("struct<actor:string,rel:string,object:string,label:string,tag:string,note:string>")
    facts = F.array(
        fact("s", "pub", F.col("brand"), F.when(F.col("flag") == "N", "-").otherwise(F.concat(F.lit("key="), "flag"))),
        fact("c", "sub", F.col("brand"), F.concat(F.lit("group="), "c")),
        F.when(F.col("c") != F.col("s"), fact("c", "http", F.col("s"), F.concat(F.lit("GET /"), "priority"))).otherwise(none),
        fact("s", "http", F.concat(F.lit("ext-"), "type"), F.concat(F.lit("POST /v1/"), "type")),
        fact("c", "grpc", F.concat(F.lit("ref-"), "segment"), F.lit("-"), "INFERENCE", F.concat(F.lit("confirm: contract of "), "segment")),
        F.when(F.col("flag") == "R", fact("s", "pub", F.concat(F.lit("returns."), "brand"), F.lit("-"))).otherwise(none),
        fact("c", "sub", F.concat(F.lit("promo."), "segment"), F.concat(F.lit("group="), "c")),
    )
    seen = (base(spark, sf_dir) if items is None else items).select("path", "line", F.explode(facts).alias("f")).filter("f is not null").select("f.actor", "f.rel", "f.object", "f.label", "f.tag", "path", "line", "f.note")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    uses = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("svc-"), F.col("n_nationkey").cast("string")).alias("actor"),
        F.lit("uses").alias("rel"),
        F.concat(F.lit("db-"), F.replace("r_name", F.lit(" "), F.lit("-"))).alias("object"),
        F.lit("sql").alias("label"),
        F.lit("CODE").alias("tag"),
        F.concat(F.lit("nations/"), F.col("n_nationkey").cast("string")).alias("path"),
        F.lit(1).alias("line"),
        F.lit(None).cast("string").alias("note"),
    )
    return seen.unionByName(uses)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's edges with all receipts."""
    return consolidate(sightings(spark, sf_dir))


def edge_tags(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """The ledger's edges without receipts: a count-like aggregate, from which lenses are cut."""
    return tags(sightings(spark, sf_dir), single)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sightings of the ledger before and after a change.

    Before, nobody published returns; after, low priorities are no longer called
    and the stores are reached by another driver.
    """
    all_ = kept_sightings(spark, sf_dir)
    old = all_.filter("not (rel = 'pub' and object like 'returns.%')")
    new = all_.filter("label <> 'GET /5-LOW'").withColumn("label", F.when(F.col("rel") == "uses", "jdbc").otherwise(F.col("label")))
    return old, new


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ledger with few nodes, for paths and cycles: kinds of events are services.

    Who does one thing after another shows a call between the two; every event
    uses the store of its amount and is published to the channel of its kind.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    svc = lambda c: F.concat(F.lit("svc-"), c)
    d = events.withColumn("next", F.lead("event_type").over(w))
    fact = lambda rel, object_, label: F.struct(F.lit(rel).alias("rel"), object_.alias("object"), F.lit(label).alias("label"))
    facts = F.array(
        F.when(F.col("next") != F.col("event_type"), fact("http", svc(F.col("next")), "GET /next")),
        fact("uses", F.when(F.col("value") < 10, "db-small").otherwise("db-large"), "sql"),
        fact("pub", F.concat(F.col("event_type"), F.lit(".seen")), "-"),
    )
    each = d.select(svc(F.col("event_type")).alias("actor"), F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.dayofyear("ts").alias("line"), F.explode(facts).alias("f")).filter("f is not null")
    return each.select("actor", "f.rel", "f.object", "f.label", F.lit("CODE").alias("tag"), "path", "line", F.lit(None).cast("string").alias("note"))


def visit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    stores = spark.range(2).select(F.when(F.col("id") == 0, "db-small").otherwise("db-large").alias("id"), F.lit("db").alias("kind"), F.lit("postgres").alias("tech"))
    svc = kinds.select(F.concat(F.lit("svc-"), "event_type").alias("id"), F.lit("svc").alias("kind"), F.lit("app").alias("tech"))
    topics = kinds.select(F.concat("event_type", F.lit(".seen")).alias("id"), F.lit("topic").alias("kind"), F.lit("kafka").alias("tech"))
    return _bound(svc.unionByName(stores).unionByName(topics))


def _bound(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("receipts", F.array(F.struct(F.concat("kind", F.lit("/"), "id").alias("path"), F.array(F.lit(1)).alias("lines"))).cast(RECEIPTS))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared nodes; each is bound at line 1 of a path made of its kind and id."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    brands = part.select("p_brand").distinct()
    segments = customer.select("c_mktsegment").distinct()
    node = lambda df, id_, kind, tech: df.select(id_.alias("id"), F.lit(kind).alias("kind"), tech.alias("tech"))
    parts = [
        node(nation, F.concat(F.lit("svc-"), F.col("n_nationkey").cast("string")), "svc", F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))),
        node(brands, F.col("p_brand"), "topic", F.lit("kafka")),
        node(brands, F.concat(F.lit("returns."), "p_brand"), "topic", F.lit("kafka")),
        node(segments, F.concat(F.lit("promo."), "c_mktsegment"), "topic", F.lit("kafka")),
        node(table(spark, sf_dir, "region"), F.concat(F.lit("db-"), F.replace("r_name", F.lit(" "), F.lit("-"))), "db", F.lit("postgres")),
        node(part.select("p_type").distinct(), F.concat(F.lit("ext-"), "p_type"), "ext", F.lit("http")),
        node(segments, F.concat(F.lit("ref-"), "c_mktsegment"), "ref", F.lit("grpc")),
    ]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return _bound(all_)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority says that it was not specified."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority like '%NOT SPECIFIED'")
    path = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"))
    return orders.select(F.col("o_orderkey").cast("string").alias("subject"), F.lit("priority not specified").alias("detail"), F.array(F.struct(path.alias("path"), F.array(F.lit(1)).alias("lines"))).cast(RECEIPTS).alias("receipts"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as a corpus of lines: ``path, line, text``."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), "text")
    from ..sources.corpus import split_lines

    return split_lines(pages.unionByName(docs))


def filled(df: DataFrame, path: str, text: str) -> DataFrame:
    """Files of a template with <column> filled in."""

    def expression(template: str):
        parts = [F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"<(\w+)>", template))]
        return F.concat(*parts)

    return df.select(expression(path).alias("path"), expression(text).alias("text"))


def idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second corpus of source files, ``path, text``: nothing but the files is known of it.

    Names stand behind constants, injected values, nested settings and variables of the
    deployment; receivers are known by their types; nations are services, whose customers and
    suppliers are their source files.
    """
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"), ((F.col("n_nationkey") + 1) % 25).cast("string").alias("m"))
    file_of = lambda name, key, at: table(spark, sf_dir, name).select(F.col(key).cast("string").alias("k"), (F.col(key) % 5).cast("string").alias("t"), F.col(at).cast("string").alias("n")).join(nation, "n")
    compose = filled(nation, "docker-compose.n<n>.yml", "services:\n    svc-<n>:\n        build: ./svc-<n>\n        environment:\n            PEER<n>_URL: http://svc-<m>:8080\n")
    package = filled(nation, "svc-<n>/package.json", '{\n "name": "@shop/svc-<n>",\n "dependencies": {"kafkajs": "2"}\n}\n')
    settings = filled(nation, "svc-<n>/src/main/resources/application.yml", "app:\n  topics:\n    made: made.<r>\n  other: other.<n>\n")
    production = filled(nation, "svc-<n>/src/main/resources/application-prod.yml", "app:\n  other: prod.<n>\n")
    names = filled(nation, "svc-<n>/src/names.ts", 'export const SHIPPED_<n> = "shipped.<r>";\n')
    contract = filled(nation, "svc-<n>/stock.proto", "service Stock<n> {\n  rpc Level (Q) returns (L);\n  rpc Move (Q) returns (L);\n}\n")
    server = filled(nation, "svc-<n>/main.go", "package main\n\nfunc main() {\n\tpb.RegisterStock<n>Server(s, srv)\n}\n")
    client = filled(nation, "svc-<n>/client.go", "package main\n\tstub := pb.NewStock<m>Client(conn)\n\tstub.Level(ctx, q)\n\tstub.Other(ctx, q)\n")
    script = filled(
        file_of("customer", "c_custkey", "c_nationkey"),
        "svc-<n>/src/c<k>.ts",
        'const BASE = process.env.PEER<n>_URL;\nconst ROOT = BASE;\nawait fetch(`${ROOT}/customers/${id}/<k>`);\nconst p: Producer = kafka.producer();\np.send(SHIPPED_<n>, m);\nres.send("no.topic");\nawait axios.get(`${process.env.NONE_<t>_URL}/x`);\n',
    )
    listener = filled(
        file_of("supplier", "s_suppkey", "s_nationkey"),
        "svc-<n>/src/S<k>.java",
        '@Value("${app.topics.made}")\nprivate String made;\nprivate final KafkaTemplate<String, Item> template;\ntemplate.send(made, item);\n@KafkaListener(topics = "${app.other}")\n'
        '@KafkaListener(topics = "${app.late:late.<t>}")\n@KafkaListener(topics = "${app.none}")\nkafkaTemplate.send("kept.<r>", item.id(), item);\n',
    )
    return reduce(DataFrame.unionByName, [compose, package, settings, production, names, contract, server, client, script, listener])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of source files, ``path, text``, written from the tables: nations are services, each with a module and a server.

    Every supplier and every customer of a nation is a file of its service, and
    regions are stores and channels; what the files say is what extraction must find.
    """
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("string").alias("n")).join(nation, "n").withColumn("k", F.col("key").cast("string"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("n")).join(nation, "n")
    customer = customer.withColumn("k", F.col("key").cast("string")).withColumn("m", (F.col("key") % 25).cast("string")).withColumn("t", (F.col("key") % 5).cast("string"))

    module = filled(nation, "svc-<n>/go.mod", "module shop.test/svc-<n>\n\nrequire google.golang.org/grpc v1.60\n")
    server = filled(nation, "svc-<n>/server.go", 'package main\n\nfunc main() {\n\tpb.RegisterNation<n>Server(s, srv)\n\tmux.HandleFunc("GET /n<n>/customers/{id}", h)\n}\n')
    settings = filled(nation, "svc-<n>/src/main/resources/application.properties", "spring.cloud.stream.bindings.audit-out-0.destination=audit.<r>\n")
    infra = filled(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("r")), "infra/region<r>.tf", 'resource "aws_sns_topic_subscription" "s" {\n  topic_arn = aws_sns_topic.prices-<r>.arn\n  endpoint  = aws_sqs_queue.work-<r>.arn\n}\n')
    python_ = filled(
        supplier,
        "svc-<n>/src/supplier<k>.py",
        'import kafka\nTOPIC = "restock.<r>"\nproducer.send(TOPIC, item, key=part)\nrequests.get("http://svc-<r>:8080/stock/<k>?full=1")\nrequests.post("https://api.bank<n>.com/v1/pay", json=body)\n'
        'engine = create_engine("postgres://app:secret@db-<r>:5432/main")\nrequests.get("http://localhost:9/health")\n',
    )
    script = filled(
        customer,
        "svc-<n>/src/customer<k>.ts",
        'import { Kafka } from "kafkajs";\nawait consumer.subscribe({ topic: "restock.<t>", groupId: "shop" });\nconst c = new Nation<m>Client(addr, grpc.credentials.createInsecure());\n'
        'await fetch("/n<m>/customers/<k>");\nawait fetch("/none/<k>");\nawait producer.send(topicOf(order));\nconst paid = await stripe.charges.create({ amount });\n',
    )
    return reduce(DataFrame.unionByName, [module, server, settings, infra, python_, script])


def deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the services and of the regions' stores: ``host, id, kind``."""
    svc = table(spark, sf_dir, "nation").select(F.concat(F.lit("svc-"), F.col("n_nationkey").cast("string")).alias("host"), F.lit("svc").alias("kind"))
    stores = table(spark, sf_dir, "region").select(F.concat(F.lit("db-"), F.col("r_regionkey").cast("string")).alias("host"), F.lit("db").alias("kind"))
    return svc.unionByName(stores).select("host", F.col("host").alias("id"), "kind")
