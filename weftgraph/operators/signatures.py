"""Signature rows as data, and the sweep that finds their call sites in one pass over the lines.

A row names a family (gated by library words), a broker or technology, the
relation its call sites show, and a pattern.  A new ecosystem is a new row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, matches, may_match
from ..sources.corpus import after_hits, enclosing_key, is_manifest, is_test


@dataclass(frozen=True)
class Signature:
    """One kind of call site: ``rel`` is the relation, ``gate`` a pattern some file must match (None: always)."""

    family: str
    rel: str
    pattern: str
    gate: str | None = None


_KAFKA = r"(?i)kafka|sarama|confluent|faust|kafkajs"
_RABBIT = r"(?i)rabbit|amqp|pika|masstransit"
_AWS = r"(?i)aws-sdk|boto3|amazonaws|aws_sdk|@aws-sdk"
_GCP = r"(?i)pubsub|google-cloud"
_NATS = r"(?i)\bnats\b|nats\.(go|py|js)|jetstream"
_AZURE = r"(?i)servicebus|eventhub"
_JOBS = r"(?i)bullmq|\bbull\b|celery|sidekiq|redis"

#: Public call names of the client libraries, by family.
SIGNATURES: tuple[Signature, ...] = (
    Signature("kafka", "pub", r"[kK]afkaTemplate\.send(Default)?\(|new ProducerRecord|@SendTo\(|\b\w*[pP]roducer\.(send|produce|send_and_wait|sendBatch)\(|\.produce\(|kafka\.(Message|WriterConfig)\{|sarama\.ProducerMessage\{|streamBridge\.send\(|\bKStream\w*\.to\(|\.to\(\s*[\"'][^\"']+[\"']\s*(,\s*Produced|\))", _KAFKA),
    Signature("kafka", "sub", r"@KafkaListener\(|@StreamListener\(|\b(AIO)?KafkaConsumer\(|\bconsumer\.subscribe\(|kafka\.ReaderConfig\{|\.ConsumePartition\(|@(EventPattern|MessagePattern)\(|@app\.agent\(|\.Consume\(\s*ctx|\b[bB]uilder\.stream\(|\bapp\.topic\(|\.subscribe\(\s*(List\.of|Arrays\.asList|Collections\.singleton|Pattern\.compile|\[)", _KAFKA),
    Signature("rabbit", "pub", r"\.convertAndSend\(|\.basic_?[pP]ublish\(|\.sendToQueue\(|\bchannel\.publish\(|\.PublishWithContext\(|\bch\.Publish\(|\.Publish\(\s*ctx|\.Publish<|\b_?(bus|publishEndpoint)\.Publish(<|\()", _RABBIT),
    Signature("rabbit", "sub", r"@RabbitListener\(|\.basic_?[cC]onsume\(|\bchannel\.consume\(|\.queue_?[bB]ind\(|\.QueueBind\(|\bbindQueue\(|@QueueBinding\b|\bch\.Consume\(|:\s*IConsumer<|\.ReceiveEndpoint\(", _RABBIT),
    Signature("aws", "pub", r"\bSendMessage(Batch)?(Command)?\(|\.send_message(_batch)?\(|\bsendMessage(Batch)?\(|\bPublishCommand\(|\bsns\.publish\(|\.put_(events|records?)\(|\bPut(Events|Records?)(Command)?\(", _AWS),
    Signature("aws", "sub", r"\b[rR]eceiveMessage(Command)?\(|\.receive_message\(|\bSqsMessageHandler\b|\bGetRecords(Command)?\(|@SqsListener\(|\.get_records\(|@KinesisListener\(", _AWS),
    Signature("gcp", "pub", r"\.topic\([^)]*\)\.publish|\bpublisher\.publish\(|\.publishMessage\(|\btopic\.Publish\(", _GCP),
    Signature("gcp", "sub", r"\.subscription\(|\.Subscription\(|\bsubscriber\.subscribe\(|\bsub\.Receive\(", _GCP),
    Signature("nats", "pub", r"\b(nc|js|nats)\.(p|P)ublish\(", _NATS),
    Signature("nats", "sub", r"\b(nc|js|nats)\.(Queue|Pull)?(s|S)ubscribe\(", _NATS),
    Signature("azure", "pub", r"\.(get_)?(queue|topic)_sender\(|\.createSender\(|\.CreateSender\(|\.SendMessageAsync\(|\.send_messages\(|\bEventHubProducerClient\b", _AZURE),
    Signature("azure", "sub", r"\.(get_)?(queue|subscription)_receiver\(|\.createReceiver\(|\.CreateProcessor\(|\bServiceBusProcessor\b|\bEventProcessorClient\b", _AZURE),
    Signature("jobs", "pub", r"\.xadd\(|\.XAdd\(|\.delay\(|\bnew Queue\(|\.apply_async\(|\.send_task\(|\.perform_async\(", _JOBS),
    Signature("jobs", "sub", r"\.xreadgroup\(|\.XReadGroup\(|\bnew Worker\(|@shared_task|@(app|celery)\.task|include Sidekiq::(Worker|Job)", _JOBS),
    Signature(
        "http",
        "http",
        r"\brequests\.(get|post|put|delete|patch|request)\(|\bhttpx\.(get|post|put|delete|patch)\(|\baiohttp\.|\bsession\.(get|post|put|delete|patch)\(|\bfetch\(|\baxios(\.\w+)?\(|\bgot(\.(get|post|put|delete|patch))?\(|\bsuperagent\.|\bky\.(get|post|put|delete|patch)\("
        r"|\bhttp\.(Get|Post|Head|PostForm|NewRequest(WithContext)?)\(|\bresty\.|\.R\(\)\.(Get|Post|Put|Delete)\(|\brestTemplate\.\w+\(|\bRestClient\.|\bWebClient\.|\bHttpClient\b|@FeignClient|@HttpExchange|@RegisterRestClient|\bRequest\.Builder\(\)"
        r"|\breqwest::|\bFaraday\.|\bNet::HTTP|\bHTTParty\.|\bnew (GuzzleHttp|Guzzle)|\bcurl_init\(|\bbaseURL\s*:|\bBaseAddress\s*=|\bbase_url\s*=|\.baseUrl\(",
    ),
    Signature("graphql", "gql", r"\bgraphql_client\.execute\(|\bgqlClient\.\w+\(|new ApolloClient\(|\bGraphQLClient\("),
    Signature("websocket", "ws", r"new WebSocket\(|\bwebsockets\.connect\(|\bwebsocket\.Dial"),
    Signature("grpc", "grpc", r"\b\w+Stub\(|\bnew(Blocking|Future)?Stub\(|\bNew\w+Client\(\s*[\w.]*(conn|Conn|cc)\b|\bnew \w+Client\([^)]*(credentials|channel)|@GrpcClient\(|\bgrpc\.(insecure_channel|Dial|DialContext|NewClient)\("),
    Signature(
        "store",
        "uses",
        r"\b(postgres(ql)?|mysql|mariadb|sqlserver|oracle|mongodb(\+srv)?|rediss?|valkey|memcached|neo4j|elasticsearch|opensearch|clickhouse|cassandra|s3)://|\bjdbc:\w+:|\bsql\.Open\(|\bgorm\.Open\(|\bpgx(pool)?\.(Connect|New)|\bcreate_engine\(|\bmongoose\.connect\(|\bMongoClient\(|\bRedis\("
        r"|\bredis\.(from_url|Redis|StrictRedis|createClient|NewClient)\(|\bAddStackExchangeRedisCache\(|\bConnectionMultiplexer\b|\bnew Jedis|\bDynamoDB(Client)?\(|\bS3Client\(|boto3\.(client|resource)\(\s*[\"'](s3|dynamodb)|\bbigquery\.(NewClient|Client)\(|\bfirestore\.(NewClient|Client)\(|\bspanner\.NewClient\(|\bCosmosClient\(|\bLettuceConnectionFactory\(|\bAlloyDBEngine\b|\balloydbconn\.|\bSpannerConnection\b|\bBlobServiceClient\(",
    ),
)


def gated(lines: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """Families whose gate occurs in a manifest or an import, outside lock files: ``family``."""
    gates = {s.family: s.gate for s in signatures}
    open_ = F.array(let(F.col("text"), lambda t: F.array(*(F.when(matches(t, g), F.lit(f)) for f, g in gates.items() if g is not None))))
    always = [f for f, g in gates.items() if g is None]
    locked = F.col("path").rlike(r"([.-]lock(\.(json|ya?ml))?|(^|/)go\.sum|lock\.hcl)$")
    imports = F.col("text").rlike(r"^\s*(import|from|using|use|require|require_relative|#include|@import)\b|\brequire\(|^\s*\"[\w./@-]+\"\s*$|\b(kafka|sarama|amqp|nats)\.\w+")
    some = lines.filter(may_match(F.col("text"), *(g for g in gates.values() if g is not None)))
    found = some.filter(~locked & (is_manifest(F.col("path")) | imports)).select(F.explode(open_).alias("all")).select(F.explode("all").alias("family")).filter("family is not null").distinct()
    return found.unionByName(lines.sparkSession.createDataFrame([(f,) for f in always], "family string")).distinct() if always else found


def sweep(lines: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES, open_families: DataFrame | None = None) -> DataFrame:
    """Call sites: ``family, rel, path, line, text, after, is_test``.

    All patterns are tried on a line in one pass, each where the line holds a text that it
    can't do without; the lines after are fetched for hits only.  Test code keeps its hits, marked; it gives no edges but may resolve values.
    """
    kind = lambda s: F.struct(F.lit(s.family).alias("family"), F.lit(s.rel).alias("rel"))
    each = let(F.col("text"), lambda t: F.array(*(F.when(matches(t, s.pattern), kind(s)) for s in signatures)))
    # the array in an array: a filter for lines without a hit would try all patterns again
    found = lines.select(*lines.columns, F.explode(F.array(each)).alias("all")).select(*lines.columns, F.explode("all").alias("s")).filter("s is not null").select("s.family", "s.rel", *lines.columns)
    hits = after_hits(lines, found, 2).select("family", "rel", "path", "line", "text", "after", is_test(F.col("path")).alias("is_test"))
    return hits if open_families is None else hits.join(F.broadcast(open_families), "family", "left_semi")


def with_wrappers(lines: DataFrame, hits: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Hits plus the call sites of confirmed project wrappers (``symbol, family, rel``)."""
    calls = lines.withColumn("symbol", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))))
    found = calls.join(wrappers.select("symbol", "family", "rel"), "symbol")
    own = after_hits(lines, found, 2).filter(~F.col("text").rlike(r"^\s*(def|func|function|async function|public|private|export)\b"))
    return hits.unionByName(own.select("family", "rel", "path", "line", "text", "after", is_test(F.col("path")).alias("is_test"))).distinct()


def real_clients(hits: DataFrame) -> DataFrame:
    """Hits without lambdas that are passed to subscribe; what a bare ``x.send(`` sends is for receivers.bare_calls()."""
    return hits.filter(~F.col("text").rlike(r"\.subscribe\(\s*(\(?\w*\)?\s*=>|\{\s*next:)"))


#: How a server registers a gRPC contract, by language; the first group is its name.
REGISTRATIONS = (r"\bRegister(\w+)Server\(", r"\badd_(\w+)Servicer_to_server\(", r"\b(\w+)Grpc\.\w+ImplBase\b", r"\bMapGrpcService<(\w+?)(?:Service)?>", r"\.addService\(\s*(?:\w+\.)*(\w+)\.service\b")
#: How a client names the contract that it calls.
STUBS = (r"\b(\w+)Stub\(", r"\b(\w+)Grpc\.new(?:Blocking|Future)?Stub\(", r"\bNew(\w+)Client\(", r"\bnew (?:\w+\.)*(\w+)Client\(", r"@GrpcClient\(\s*[\"']([^\"']+)")


def first_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def registrations(lines: DataFrame) -> DataFrame:
    """Servers' registrations of gRPC contracts: ``name, path, line``."""
    return lines.filter(~F.col("path").endswith(".proto") & may_match(F.col("text"), *REGISTRATIONS)).select(first_of(F.col("text"), REGISTRATIONS).alias("name"), "path", "line").filter("name is not null")


def binding_direction(name: Column) -> Column:
    """pub or sub of a stream binding by the words of its name; null if they don't tell."""
    return F.when(F.lower(name).rlike(r"(^|[-_.])(out(put)?|producer|supplier|source)([-_.0-9]|$)"), "pub").when(F.lower(name).rlike(r"(^|[-_.])(in(put)?|consumer|sink|listener)([-_.0-9]|$)"), "sub")


def stream_bindings(config: DataFrame) -> DataFrame:
    """Stream bindings among configuration values: ``path, line, rel, channel``."""
    name = F.regexp_extract("key", r"^spring\.cloud\.stream\.bindings\.(.+)\.destination$", 1)
    return config.withColumn("rel", binding_direction(name)).filter((name != "") & F.col("rel").isNotNull()).select("path", "line", "rel", F.col("value").alias("channel"))


def iac_channels(lines: DataFrame) -> DataFrame:
    """Channels that infrastructure code declares: ``path, line, kind, tech, name``."""
    kinds = (("topic", "kafka", r"resource\s+\"kafka_topic\"\s+\"([^\"]+)\""), ("queue", "sqs", r"resource\s+\"aws_sqs_queue\"\s+\"([^\"]+)\""), ("topic", "sns", r"resource\s+\"aws_sns_topic\"\s+\"([^\"]+)\""), ("topic", "pubsub", r"resource\s+\"google_pubsub_topic\"\s+\"([^\"]+)\""), ("queue", "pubsub", r"resource\s+\"google_pubsub_subscription\"\s+\"([^\"]+)\""), ("queue", "servicebus", r"resource\s+\"azurerm_servicebus_queue\"\s+\"([^\"]+)\""), ("topic", "servicebus", r"resource\s+\"azurerm_servicebus_topic\"\s+\"([^\"]+)\""))
    each = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("tech"), F.regexp_extract("text", p, 1).alias("name"))) for k, t, p in kinds)))
    terraform = lines.filter(F.col("path").rlike(r"\.tf$")).select("path", "line", F.explode(each).alias("c")).select("path", "line", "c.kind", "c.tech", "c.name")
    # CloudFormation: the resource's key stands two spaces in, its type below; a topic's own manifest: kind, then metadata.name
    yaml = lines.filter(F.col("path").rlike(r"\.(ya?ml|template)$"))
    types = F.regexp_extract("text", r"^\s+Type:\s*[\"']?AWS::(SQS::Queue|SNS::Topic|Kinesis::Stream)", 1)
    typed = enclosing_key(yaml).withColumn("type", types).filter("type <> '' and section = 'Resources' and entry is not null")
    cloud = typed.select("path", "line", F.when(F.col("type") == "SQS::Queue", "queue").otherwise("topic").alias("kind"), F.lower(F.substring_index("type", "::", 1)).alias("tech"), F.col("entry").alias("name"))
    topics = yaml.filter(F.col("text").rlike(r"^kind:\s*KafkaTopic\s*$")).select("path").distinct()
    named = enclosing_key(yaml.join(topics, "path", "left_semi")).filter("section = 'metadata'").withColumn("name", F.regexp_extract("text", r"^  name:\s*[\"']?([A-Za-z0-9._-]+)", 1)).filter("name <> ''")
    return terraform.unionByName(cloud).unionByName(named.select("path", "line", F.lit("topic").alias("kind"), F.lit("kafka").alias("tech"), "name"))


def iac_subscriptions(lines: DataFrame) -> DataFrame:
    """``topic, queue, path, line``: a queue that subscribes to a topic, by the references inside one resource."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("text").rlike(r"^resource "), F.when(F.col("text").contains('"aws_sns_topic_subscription"'), F.col("line")).otherwise(F.lit(0)))
    tf = lines.filter(F.col("path").rlike(r"\.tf$")).withColumn("block", F.last(opened, ignorenulls=True).over(w)).filter("block > 0")
    ref = lambda kind: F.max(F.nullif(F.regexp_extract("text", rf"{kind}\.([A-Za-z0-9_-]+)\.", 1), F.lit("")))
    return tf.groupBy("path", F.col("block").alias("line")).agg(ref("aws_sns_topic").alias("topic"), ref("aws_sqs_queue").alias("queue")).filter("topic is not null and queue is not null").select("topic", "queue", "path", "line")


def rpc_calls(lines: DataFrame) -> DataFrame:
    """Calls on stubs: ``name, path, line, rpc`` of the contract, the stub's line and the called method.

    A call belongs to the last stub that its variable was given above it; calls chained to
    the stub's construction count as well.  Methods are compared without the case of their first letter.
    """
    from ..operators.values import MOST_CHARS

    text = F.substring("text", 1, MOST_CHARS)
    made = lines.filter(~F.col("path").endswith(".proto") & may_match(F.col("text"), *STUBS)).select("path", "line", text.alias("text"), first_of(text, STUBS).alias("name")).filter("name is not null")
    held = made.withColumn("var", F.regexp_extract("text", r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:,\s*\w+)?\s*(?::\s*[\w.]+\s*)?(?::=|=)(?!=)", 1)).filter("var <> ''").select("path", "var", "name", F.col("line").alias("made"))
    called = lines.select("path", "line", F.explode(F.regexp_extract_all(text, F.lit(r"\b(?:this\.|self\.)?(\w+\.[A-Za-z]\w*)\("), F.lit(1))).alias("c")).select("path", "line", F.substring_index("c", ".", 1).alias("var"), F.substring_index("c", ".", -1).alias("rpc"))
    by_var = called.join(held, ["path", "var"]).filter("line >= made").groupBy("path", "line", "var", "rpc").agg(F.max(F.struct("made", "name")).alias("m")).select("m.name", "path", F.col("m.made").alias("line"), "rpc")
    chained = made.withColumn("rpc", F.regexp_extract("text", r"(?:Stub|Client)\([^()]*(?:\([^()]*\))?[^()]*\)\.([A-Za-z]\w*)\(", 1)).filter("rpc <> ''").select("name", "path", "line", "rpc")
    return by_var.unionByName(chained).distinct()


def rpcs(lines: DataFrame) -> DataFrame:
    """Methods that contracts declare: ``name, rpc``."""
    proto = lines.filter(F.col("path").endswith(".proto"))
    from pyspark.sql import Window

    service = F.nullif(F.regexp_extract("text", r"^\s*service\s+(\w+)", 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = proto.withColumn("name", F.last(service, ignorenulls=True).over(w)).filter("name is not null")
    return inside.select("name", F.explode(F.regexp_extract_all("text", F.lit(r"\brpc\s+(\w+)"), F.lit(1))).alias("rpc")).distinct()


def uncovered(manifests: DataFrame, covered: tuple[str, ...] = ("npm", "go", "python", "maven", "gradle", "compose", "docker", "spring", "helm")) -> DataFrame:
    """Ecosystems of the corpus that no signature row speaks for."""
    return manifests.filter(~F.col("ecosystem").isin(*covered)).select("ecosystem").distinct()
