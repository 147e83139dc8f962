"""From call sites to edges: the ordered ladder that finds what a call names.

The first rung that gives a value wins.  What cannot be named is a gap, never an
edge; what can be named but not resolved is an inferred edge (messages) or a gap
(calls).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept, spread
from . import values as V

MESSAGES = ("pub", "sub")


def symbols(lines: DataFrame) -> DataFrame:
    """Constants and defaults of environment variables: ``path, line, key, value``."""
    constant = r"^\s*(?:export\s+)?(?:(?:public|private|static|final|const|let|var|val|String)\s+)*([A-Za-z_][A-Za-z0-9_]*)\s*(?::\s*\w+\s*)?(?::=|=)\s*[\"'`]([^\"'`]+)[\"'`]"
    default = r"([A-Za-z_][A-Za-z0-9_]*)\s*(?::=|=)\s*.*(?:getenv|environ\.get|Getenv|getEnv|envOr|env)\w*\(\s*[\"'][A-Za-z0-9_]+[\"']\s*,\s*[\"']([^\"']+)[\"']"
    node = r"([A-Za-z_][A-Za-z0-9_]*)\s*=\s*process\.env\.\w+\s*(?:\|\||\?\?)\s*[\"'`]([^\"'`]+)"
    key = value = F.lit(None).cast("string")
    for p in (constant, default, node):
        hit = F.col("text").rlike(p)
        key, value = F.when(hit, F.regexp_extract("text", p, 1)).otherwise(key), F.when(hit, F.regexp_extract("text", p, 2)).otherwise(value)
    return lines.select("path", "line", key.alias("key"), value.alias("value")).filter("key is not null")


#: An argument up to the comma or bracket that ends it: texts, one level of nested brackets.
_ARGUMENT = r"\s*[\[{]*\s*((?:[^,()\[\]{}\"'`]++|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|`[^`]*+`|\((?:[^()\"'`]++|\"[^\"]*+\"|'[^']*+'|`[^`]*+`|\([^()]*+\))*+\)|\[\s*[\"'][^\]]*+\])++)"
#: What opens the argument that names a channel or an address, the surest first.
_OPENERS = (
    r"\.(?:topic|subscription|Topic|Subscription)\(",
    r"\b(?:ProducerRecord\s*(?:<[^>]*>)?|(?:List\.of|Arrays\.asList|Collections\.singleton(?:List)?|Pattern\.compile)|(?:Publish|SendMessage\w*|ReceiveMessage\w*|PutEvents|PutRecords?|GetRecords)Command)\(",
    r"\b(?:NewRequest|request|Request)\(\s*[\"'`][A-Za-z]+[\"'`]\s*,",
    r"\bNewRequestWithContext\([^,]+,\s*(?:[\"'][A-Z]+[\"']|http\.Method\w+)\s*,",
    r"\bNewRequest\(\s*http\.Method\w+\s*,",
    r"(?i)\b\w*(?:send|send_?message\w*|send_and_wait|send_?batch|produce|publish\w*|emit|subscribe|queuesubscribe|pullsubscribe|consume\w*|listener|eventpattern|messagepattern|agent|task|sendto|sendtoqueue|convertandsend|consumepartition|receiveendpoint|bind_?queue|queue_?bind|xadd|xreadgroup|queue|worker|apply_async|send_task|perform_async|\w*sender|\w*receiver|\w*processor|kafkaconsumer|stream|to|receive_?message\w*)\s*(?:<[^>(]*>)?\(",
    r"\b(?:fetch|get|post|put|patch|delete|head|Get|Post|Head|PostForm|request|uri|axios|got|baseUrl|connect|Connect|Dial|execute|create_engine|Open|WebSocket|MongoClient|Redis|from_url|createClient|NewClient|insecure_channel|forAddress)(?:ForObject|ForEntity)?\s*(?:<[^>(]*>)?\(",
    r"^[^({]*[({]",
)
_CHANNEL = r"(?i)\b(?:topics?|destination|exchange|queues?|queue_?(?:url|name)|topic_?(?:arn|name|id)|stream_?name|subject|channel)\b[\"']?\s*(?:=|:(?!=))(?!=)"
_ADDRESS = r"(?i)\b(?:url|uri|base_?url|baseaddress|endpoint|host|addr(?:ess)?)\b[\"']?\s*(?:=|:(?!=))(?!=)"
_URL = r"([fFrRbBuU@$]{0,2}(?:\"[a-zA-Z][a-zA-Z0-9+.-]*://[^\"]*\"|'[a-zA-Z][a-zA-Z0-9+.-]*://[^']*'|`[a-zA-Z][a-zA-Z0-9+.-]*://[^`]*`))"


def _named(hits: DataFrame) -> DataFrame:
    """``expression`` that a call site names its target by, and the line ``at`` which it stands.

    A field that says so (``topic:``, ``QueueUrl=``, ``url:``) on the line or the ones after it, else the
    first argument; of calls to addresses and stores also any URL that stands on the line.
    """
    # the next lines count only while a bracket of the call is open: what follows is another statement
    without = lambda t, brackets: sum(F.octet_length(F.replace(t, F.lit(b))) for b in brackets)
    depth = lambda t: (without(t, ")]}") - without(t, "([{")).cast("int")
    so_far = lambda i: F.aggregate(F.slice("after", 1, i), F.col("depth"), lambda d, t: d + depth(t))
    hits = hits.withColumn("depth", depth(F.col("text")))
    hits = hits.withColumn("after", F.when(F.col("depth") > 0, F.filter("after", lambda _, i: so_far(i) > 0)).otherwise(F.array().cast("array<string>"))).drop("depth")
    message = F.col("rel").isin(*MESSAGES)
    cut = lambda t: F.substring(t, 1, V.MOST_CHARS)
    near = F.concat(F.array("text"), "after")
    argument_of = lambda t, opener: F.when(T.may_match(t, opener), F.trim(F.regexp_extract(cut(t), opener + _ARGUMENT, 1))).otherwise(F.lit(""))
    said = lambda t, i, opener: F.struct(argument_of(t, opener).alias("e"), i.alias("i"))
    first = lambda pattern: F.get(F.filter(F.transform(near, lambda t, i: said(t, i, pattern)), lambda x: x["e"] != ""), F.lit(0))
    # the first that says something, each tried once
    here = reduce(lambda rest, o: T.let(argument_of(F.col("text"), o), lambda e: F.when(e != "", e).otherwise(rest)), reversed(_OPENERS), F.lit(None).cast("string"))
    hits, here = hits.withColumn("here", here), F.col("here")
    # a call that goes on in the next line
    below = F.trim(F.regexp_extract(cut(F.coalesce(F.get("after", F.lit(0)), F.lit(""))), "^" + _ARGUMENT, 1))
    argument = F.when(here.isNotNull(), F.struct(here.alias("e"), F.lit(0).alias("i"))).when((below != "") & F.col("text").rlike(r"[(\[{]\s*$"), F.struct(below.alias("e"), F.lit(1).alias("i")))
    hits = hits.withColumn("url", F.when(T.may_match(F.col("text"), _URL), F.regexp_extract(cut(F.col("text")), _URL, 1)).otherwise(F.lit("")))
    url = F.col("url")
    literal = F.when((url != "") & ~F.coalesce(here.contains("://"), F.lit(False)), F.struct(url.alias("e"), F.lit(0).alias("i")))
    hits = hits.withColumn("field", F.when(message, first(_CHANNEL)).otherwise(first(_ADDRESS)))
    found = F.when(message, F.coalesce("field", argument)).otherwise(F.coalesce(literal, F.when(here.contains("://"), argument), "field", argument))
    d = hits.withColumn("found", found)
    return d.withColumn("parts", V.parts_of(F.col("found.e"))).withColumn("at", (F.col("line") + F.coalesce(F.col("found.i"), F.lit(0))).cast("int")).drop("found", "here", "url", "field")


def ladder(hits: DataFrame, defined: DataFrame, config: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """Hits with ``rung, value, tag, places, variants``: places are ``array<struct<path, line>>``, the binding of a literal first.

    ``defined`` are values.definitions(), ``config`` key_trees(), ``homes`` (``path, home``) the
    services of files.  The rung is the weakest that a part of the value needed.  What stays a
    symbol is ``KEY?`` for a channel (rung 6), and computed (rung 7) for an address, unless it stands in its path.
    """
    h = _named(hits).withColumn("id", F.xxhash64(F.lit("site"), "path", "line", "family", "rel"))
    h = kept(h)
    # sites that name nothing but text are through
    asking = h.filter(V.is_open(F.col("parts")))
    done = V.flow(asking.select("id", "path", F.col("line").cast("int").alias("line"), "parts").dropDuplicates(["id"]), defined, V.config_definitions(config), homes)
    j = asking.drop("parts").join(done, "id").unionByName(h.filter(~V.is_open(F.col("parts"))).withColumn("variants", F.lit("")))
    message = F.col("rel").isin(*MESSAGES)
    text = V.value_of(F.col("parts"))
    open_ = F.filter("parts", lambda p: p["kind"] != "text")
    last = F.get(open_, F.lit(0))
    symbol = F.when(last["kind"] == "name", T.last_dotted(last["text"])).otherwise(last["text"])
    whole = F.size(open_) == 0
    hosted = text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/{}?#]+([/?#]|$)") | text.rlike(r"^[A-Za-z0-9.-]+:[0-9]+(/|$)") | text.startswith("/")
    weakest = F.array_max(F.transform("parts", lambda p: F.when(p["kind"] == "text", p["rung"]).otherwise(1)))
    rung = F.when(F.coalesce(F.size("parts"), F.lit(0)) == 0, 7).when(whole, weakest).when(message & (F.size("parts") == 1) & (last["kind"] != "call"), 6).when(~message & hosted, weakest).otherwise(7)
    value = F.when(F.col("rung") == 6, F.concat(symbol, F.lit("?"))).when(F.col("rung") < 6, text)
    place = lambda p, n: F.struct(p.alias("path"), n.cast("int").alias("line"))
    site, at = place(F.col("path"), F.col("line")), place(F.col("path"), F.col("at"))
    places = F.when(F.col("rung") == 1, F.array(at, site)).otherwise(F.concat(F.array(site, at), F.flatten(F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: p["places"]))))
    places = F.when(F.col("rung") > 5, F.array(site)).otherwise(places)
    j = j.withColumn("rung", rung).withColumn("value", value)
    return j.select("family", "rel", "path", "line", "text", "after", symbol.alias("ident"), "is_test", "variants", "rung", "value", F.when(F.col("rung") < 5, "CODE").when(F.col("rung") < 7, "INFERENCE").alias("tag"), F.array_distinct(places).alias("places"))


#: The key between topic and value of a template's call.
_MIDDLE = r"\b\w*[kK]afkaTemplate\.send\(\s*(?:\"[^\"]*\"|[\w.]+)\s*,\s*\"?([A-Za-z_][\w.]*)\"?(?:\(\))?\s*,"


def message_label(rel: Column, text: Column) -> Column:
    """``key=``, ``rk=``, ``group=`` or ``queue=`` of a message call site, as far as it says; else null."""
    word = r"\s*[:=(]+\s*(?:\[\]byte\()?[\"'`]?([A-Za-z_][A-Za-z0-9_.*#-]*)"
    said = lambda name: F.when(T.may_match(text, rf"\b{name}{word}"), F.nullif(F.regexp_extract(text, rf"\b{name}{word}", 1), F.lit("")))
    of = lambda label, name: F.concat(F.lit(f"{label}="), said(name))
    return F.when(rel == "pub", F.coalesce(of("key", "[kK]ey"), of("rk", "[rR]outing_?[kK]ey"), F.concat(F.lit("key="), F.nullif(T.last_dotted(F.regexp_extract(text, _MIDDLE, 1)), F.lit(""))))).otherwise(F.coalesce(of("group", "[gG]roup(?:_?[iI][dD])?"), of("queue", "[qQ]ueue")))


def target(resolved: DataFrame, hosts: DataFrame) -> DataFrame:
    """Resolved hits with ``object, kind, label, tag, gap``.

    ``hosts`` (``host, id, kind``) are deployables and services.  A known host is
    that node; a public domain is external; a bare unknown host is a reference by
    inference; loopback is skipped; a path alone is a gap, and so is a value that can't name a channel.
    """
    value = F.col("value")
    url_host = F.coalesce(T.host(value), F.when(value.rlike(r"^[A-Za-z0-9.-]+(:[0-9]+)(/|$)"), F.substring_index(value, ":", 1)))
    # names inside a cluster or a private network are known by their first part
    private = url_host.rlike(r"\.(svc|local|internal|lan|cluster)$|\.svc\.")
    url_host = F.when(private, F.substring_index(url_host, ".", 1)).otherwise(url_host)
    d = resolved.withColumn("host", F.when(~F.col("rel").isin(*MESSAGES), url_host))
    d = d.join(hosts.select("host", F.col("id").alias("known"), F.col("kind").alias("known_kind")), "host", "left")
    message = F.col("rel").isin(*MESSAGES)
    channel = T.last_segment(value)
    public = F.col("host").contains(".")
    object_ = F.when(message, F.when(F.col("rung") == 6, value).otherwise(channel)).otherwise(F.coalesce("known", "host", F.when(F.col("rel").isin("grpc", "uses"), F.coalesce(F.regexp_extract("text", r"\b(\w+)Stub\(", 1), value))))
    kind = F.when(message, "topic").when(F.col("known").isNotNull(), F.col("known_kind")).when(F.col("rel") == "uses", "store").when(public, "ext").otherwise("ref")
    method = F.upper(F.regexp_extract("text", r"\.(get|post|put|delete|patch|Get|Post)\(", 1))
    path = F.regexp_extract(value, r"^(?:[a-z+]+://[^/]+|[A-Za-z0-9.-]+:[0-9]+)(/[^\"'`]*)", 1)
    near = F.array_join(F.concat(F.array("text"), "after"), " ") if "after" in resolved.columns else F.col("text")
    label = F.when(message, message_label(F.col("rel"), near)).when(F.col("rel") == "uses", optional_label(T.engine(value), F.col("text"))).when((F.col("rel") == "http") & (path != ""), T.http_label(F.when(method == "", "ANY").otherwise(method), path)).otherwise("-")
    tag = F.when(message, F.col("tag")).when(F.col("known").isNotNull(), F.col("tag")).when(public, F.col("tag")).otherwise("INFERENCE")
    skip = F.coalesce(T.is_loopback(F.col("host")), F.lit(False))
    rejected = message & ~F.coalesce(T.valid_channel(channel), F.lit(False)) & (F.col("rung") < 6)
    named = F.coalesce(object_, F.lit("")) != ""
    gap = F.when(rejected, F.concat_ws(" ", F.lit("no channel name:"), "rel", value)).when(~named | (F.col("rung") == 7) & (F.col("rel") != "grpc"), F.concat_ws(" ", F.lit("unresolved"), "rel", F.col("ident")))
    return d.filter(~skip).select(*resolved.columns, F.when(gap.isNull(), object_).alias("object"), kind.alias("kind"), F.coalesce(label, F.lit("-")).alias("label"), tag.alias("edge_tag"), gap.alias("gap"))


def edges_of(targets: DataFrame, owned: DataFrame) -> DataFrame:
    """Sightings of the services that own the call sites; self calls, test code and unowned files give none."""
    d = targets.filter("gap is null and not is_test").join(owned.select("path", F.col("service_id").alias("actor")), "path").filter("actor is not null and actor <> object")
    told = F.nullif(F.col("variants"), F.lit("")) if "variants" in targets.columns else F.lit(None).cast("string")
    note = F.when(F.col("edge_tag") != "CODE", F.concat_ws("; ", F.concat(F.lit("confirm: what "), F.coalesce("ident", "object"), F.lit(" names")), told)).otherwise(told)
    return d.select("actor", "rel", "object", "label", F.col("edge_tag").alias("tag"), F.posexplode("places").alias("rank", "p"), note.alias("note")).select("actor", "rel", "object", "label", "tag", F.col("p.path").alias("path"), F.col("p.line").alias("line"), "note")


def gaps_of(targets: DataFrame, owned: DataFrame) -> DataFrame:
    """``subject, detail, path, line`` of what could not be named."""
    d = targets.filter("gap is not null and not is_test").join(owned.select("path", F.col("service_id").alias("subject")), "path", "left")
    return d.select(F.coalesce("subject", "path").alias("subject"), F.col("gap").alias("detail"), "path", "line")


def unread_variables(addresses: DataFrame, lines: DataFrame) -> DataFrame:
    """Declared variables without a read, and reads without a declaration: ``var, state``."""
    declared = addresses.filter(F.col("path").rlike(r"\.(ya?ml|env)$|(^|/)\.env")).select("var").distinct()
    read = lines.filter(~F.col("path").rlike(r"\.(ya?ml|env)$|(^|/)\.env")).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:getenv|environ\.get|Getenv|getEnv|env)\w*[\(\[]\s*[\"']([A-Z][A-Z0-9_]+)|process\.env\.([A-Z][A-Z0-9_]+)"), F.lit(1))).alias("var"))
    node = lines.select(F.explode(F.regexp_extract_all("text", F.lit(r"process\.env\.([A-Z][A-Z0-9_]+)"), F.lit(1))).alias("var"))
    read = read.unionByName(node).filter("var <> ''").distinct()
    return declared.join(read, "var", "left_anti").select("var", F.lit("unread").alias("state")).unionByName(read.join(declared, "var", "left_anti").select("var", F.lit("undeclared").alias("state")))


def matched_routes(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """Path-only calls (``path, line, template``) against route templates: one match is an inference, none a gap."""
    n = F.count("service_id").over(Window.partitionBy("path", "line"))
    return paths.join(routes.select("template", "service_id").distinct(), "template", "left").withColumn("matches", n).withColumn("outcome", F.when(F.col("matches") == 1, "INFERENCE").otherwise("GAP"))


def _segments(template: Column) -> Column:
    return F.filter(F.split(template, "/"), lambda s: s != "")


def _wild(segment: Column) -> Column:
    return segment.rlike(r"^(\{.*\}|:.+|<.+>|\*)$")


def route_matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls (``path, line, method, template``) with the route that serves them, segment by segment.

    ``routes`` has ``method, template, service_id``.  A route's wildcard matches any one segment; of
    the routes that match, the one with the most literal segments wins, then the one whose
    literals stand further left.  A call's own wildcard (an id) matches wildcards only; a
    method ANY, of call or route, matches all.  Returns the columns of ``calls`` and ``route,
    service_id, matches, outcome``: INFERENCE for one service, GAP for none or several of equal rank.

    Routes of the same shape (number of segments, places of the literals) share a key made of
    their literals, so a call takes one equi-join for each shape of its length, not a comparison with every route.
    """
    parts = F.col("parts")
    shaped = routes.select(F.upper("method").alias("verb"), F.col("template").alias("route"), "service_id", _segments(F.col("template")).alias("parts")).distinct()
    mask = F.array_join(F.transform(parts, lambda s: F.when(_wild(s), "0").otherwise("1")), "")
    shaped = shaped.select("verb", "route", "service_id", F.size(parts).alias("n"), mask.alias("mask"), F.array_join(F.filter(parts, lambda s: ~_wild(s)), "/").alias("key"))
    own = calls.withColumn("parts", _segments(F.col("template"))).withColumn("n", F.size("parts")).join(shaped.select("n", "mask").distinct(), "n")
    literal = lambda i: F.substring("mask", i + 1, F.lit(1)) == "1"
    own = own.withColumn("key", F.array_join(F.filter(parts, lambda _, i: literal(i)), "/")).filter(~F.exists(F.filter(parts, lambda _, i: literal(i)), _wild))
    met = own.join(shaped, ["n", "mask", "key"]).filter((F.col("verb") == "ANY") | (F.upper("method") == "ANY") | (F.upper("method") == F.col("verb")))
    rank = F.struct(F.char_length(F.replace("mask", F.lit("0"))).alias("literals"), "mask")
    per = met.groupBy(*calls.columns, rank.alias("rank")).agg(F.count_distinct("service_id").alias("matches"), F.min(F.struct("service_id", "route")).alias("r"))
    best = per.groupBy(*calls.columns).agg(F.max_by(F.struct("matches", "r"), "rank").alias("b"))
    # grouping takes null columns as equal, a join would not
    out = calls.distinct().join(best.select(*(F.col(c).alias(f"_{c}") for c in calls.columns), "b"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in calls.columns], "left")
    n = F.coalesce(F.col("b.matches"), F.lit(0))
    return out.select(*calls.columns, F.col("b.r.route").alias("route"), F.col("b.r.service_id").alias("service_id"), n.alias("matches"), F.when(n == 1, "INFERENCE").otherwise("GAP").alias("outcome"))


def contract_tag(stubs: DataFrame, registrations: DataFrame, hints: DataFrame) -> DataFrame:
    """gRPC stubs (``name``) with the service that registers the contract, or a hint, or neither."""
    reg = registrations.select("name", F.col("service_id").alias("server")).distinct()
    hint = hints.select("name", F.col("service_id").alias("likely")).distinct()
    d = stubs.join(reg, "name", "left").join(hint, "name", "left")
    return d.select("name", F.coalesce("server", "likely", "name").alias("object"), F.when(F.col("server").isNotNull() | F.col("likely").isNotNull(), "svc").otherwise("ref").alias("kind"), F.when(F.col("server").isNotNull(), "CODE").otherwise("INFERENCE").alias("tag"))


def bound_exchange(consumers: DataFrame, bindings: DataFrame) -> DataFrame:
    """Queue consumers: bound queues subscribe to the exchange with ``queue=``, others to the queue, with a gap."""
    d = consumers.join(bindings.select("queue", "exchange").distinct(), "queue", "left")
    bound = F.col("exchange").isNotNull()
    return d.select(*consumers.columns, F.coalesce("exchange", "queue").alias("object"), F.when(bound, F.concat(F.lit("queue="), "queue")).otherwise("-").alias("label"), F.when(~bound, F.concat(F.lit("no binding for "), "queue")).alias("gap"))


def path_calls(resolved: DataFrame, lines: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that name a path only, against the routes of all services: sightings of the one match, and gaps.

    A match is an inference that cites the route beside the call.
    """
    from ..sources import corpus

    calls = resolved.filter((F.col("rel") == "http") & F.col("value").startswith("/") & ~F.col("is_test"))
    verb = F.upper(F.regexp_extract("text", r"\.(get|post|put|delete|patch|Get|Post)\(", 1))
    calls = kept(calls.groupBy("path", "line", T.template(F.col("value")).alias("template")).agg(F.max(verb).alias("method")).withColumn("method", F.when(F.col("method") == "", "ANY").otherwise(F.col("method"))))
    routes = kept(corpus.routes(lines).join(owned.select("path", "service_id"), "path").filter("service_id is not null"))
    first = routes.groupBy(F.col("template").alias("route"), "service_id").agg(F.min(F.struct("path", "line")).alias("at"))
    matched = kept(route_matches(calls, routes.select("method", "template", "service_id")))
    caller = owned.select("path", F.col("service_id").alias("actor"))
    one = matched.filter("outcome = 'INFERENCE'").join(first, ["route", "service_id"]).join(caller, "path").filter("actor is not null and actor <> service_id")
    label = T.http_label(F.col("method"), F.col("route"))
    places = F.array(F.struct("path", "line"), F.col("at"))
    seen = one.select("actor", F.lit("http").alias("rel"), F.col("service_id").alias("object"), label.alias("label"), F.lit("INFERENCE").alias("tag"), F.explode(places).alias("p"), F.concat(F.lit("confirm: the only route "), "route").alias("note"))
    gaps = matched.filter("outcome = 'GAP'").select("path", "line", "template").distinct().join(caller, "path", "left")
    return seen.select("actor", "rel", "object", "label", "tag", "p.path", "p.line", "note"), gaps.select(F.coalesce("actor", "path").alias("subject"), F.concat(F.lit("no single route "), "template").alias("detail"), "path", "line")


def grpc_calls(resolved: DataFrame, lines: DataFrame, owned: DataFrame) -> DataFrame:
    """Sightings of gRPC stubs by the owner of their contract: the service that registers it, else the one whose folder holds it."""
    from ..sources import corpus
    from . import signatures as S

    stubs = resolved.filter((F.col("rel") == "grpc") & ~F.col("is_test")).select(S.first_of(F.col("text"), S.STUBS).alias("name"), "path", "line").filter("name is not null")
    service = owned.select("path", "service_id").filter("service_id is not null")
    registered = S.registrations(lines).join(service, "path").select("name", "service_id").distinct()
    hinted = corpus.contracts(lines).join(service, "path").select("name", "service_id").distinct()
    to = contract_tag(stubs.select("name").distinct(), registered, hinted)
    calls = stubs.join(to, "name").join(service.withColumnRenamed("service_id", "actor"), "path")
    # a caller's own copy of a contract says nothing of its server
    calls = calls.withColumn("object", F.when((F.col("tag") != "CODE") & (F.col("actor") == F.col("object")), F.col("name")).otherwise(F.col("object"))).filter("actor <> object")
    called = S.rpc_calls(lines).withColumn("k", F.lower("rpc")).join(S.rpcs(lines).select("name", F.lower("rpc").alias("k"), F.col("rpc").alias("declared")), ["name", "k"])
    called = called.groupBy("name", "path", "line").agg(F.array_sort(F.collect_set("declared")).alias("rpcs"))
    calls = calls.join(called, ["name", "path", "line"], "left")
    note = F.when(F.col("tag") != "CODE", F.concat(F.lit("confirm: who serves "), "name"))
    return calls.select("actor", F.lit("grpc").alias("rel"), "object", rpc_label(F.col("rpcs")).alias("label"), "tag", "path", "line", note.alias("note"))


def rpc_label(rpcs: Column, most: int = 6) -> Column:
    """Up to six names, and the number of those beyond; ``-`` for none."""
    shown = F.array_join(F.slice(rpcs, 1, most), ", ")
    return F.coalesce(F.when(F.size(rpcs) > most, F.concat(shown, F.lit(", +"), (F.size(rpcs) - most).cast("string"), F.lit(" more"))).when(F.size(rpcs) > 0, shown), F.lit("-"))


def surroundings(files: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Services (``service_id, root_path``) and hosts (``host, id, kind``) that a corpus declares itself.

    Services by their manifests, under the name of the deployable that runs them, without
    those that own no code; hosts are deployables, services, and the servers of API descriptions.
    ``lines`` are those of the files, where they have been split already.
    """
    from ..sources import corpus
    from ..sources.keys import key_trees

    swept = files.filter(~corpus.is_excluded(F.col("path")))
    lines = corpus.split_lines(swept) if lines is None else lines
    units = kept(corpus.declared_units(key_trees(swept)))
    named = corpus.named_by_deployment(corpus.service_names(lines), units)
    services = kept(corpus.without_wrappers(named, swept).select("service_id", "root_path").distinct())
    deployed = corpus.deployable_hosts(units)
    own = services.select(F.col("service_id").alias("host")).join(deployed.select("host"), "host", "left_anti").select("host", F.col("host").alias("id"), F.lit("svc").alias("kind")).distinct()
    owned = corpus.owners(swept, services)
    # a description in a service's folder says under which hosts it is reached
    api = corpus.api_hosts(lines).join(owned.filter("service_id is not null"), "path").groupBy("host").agg(F.min("service_id").alias("id"))
    known = deployed.unionByName(own)
    return services, kept(known.unionByName(api.join(known.select("host"), "host", "left_anti").select("host", "id", F.lit("svc").alias("kind"))))


def declared_nodes(files: DataFrame) -> DataFrame:
    """Nodes that manifests, deployment and infrastructure code declare: ``id, kind, tech, path, line``."""
    from ..sources import corpus
    from ..sources.keys import key_trees
    from . import signatures as S

    swept = files.filter(~corpus.is_excluded(F.col("path")))
    lines = corpus.split_lines(swept)
    units = kept(corpus.declared_units(key_trees(swept)))
    named = corpus.without_wrappers(corpus.named_by_deployment(corpus.service_names(lines), units), swept)
    svc = named.select(F.col("service_id").alias("id"), F.lit("svc").alias("kind"), "tech", "path", "line")
    kinds = corpus.deployable_hosts(units)
    first = units.groupBy("name").agg(F.min(F.struct("path", "line", "image")).alias("u")).join(kinds, F.col("name") == F.col("host"))
    image = F.lower(F.regexp_extract("u.image", r"^(?:.*/)?([^/:@]+)", 1))
    deployed = first.join(svc, "id", "left_anti").select("id", "kind", image.alias("tech"), "u.path", "u.line")
    channels = S.iac_channels(lines).select(F.col("name").alias("id"), "kind", "tech", "path", "line")
    all_ = svc.unionByName(deployed).unionByName(channels)
    return all_.groupBy("id", "kind").agg(F.min(F.struct("path", "line", "tech")).alias("n")).select("id", "kind", "n.tech", "n.path", "n.line")


def undeclared_variables(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Gaps of variables that code reads as an address or channel and no configuration declares: ``subject, detail, path, line``."""
    from ..sources import corpus
    from ..sources.keys import key_trees

    own = ~corpus.is_excluded(F.col("path")) & ~corpus.is_test(F.col("path"))
    swept = files.filter(own)
    some = (corpus.split_lines(swept) if lines is None else lines.filter(own)).filter(T.may_match(F.col("text"), V.READ))
    read = some.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(V.READ), F.lit(0))).alias("t"))
    var = F.coalesce(*(F.nullif(F.regexp_extract("t", V.READ, g), F.lit("")) for g in (1, 3, 4)))
    fallback = F.coalesce(*(F.nullif(F.regexp_extract("t", V.READ, g), F.lit("")) for g in (2, 5)))
    wanted = read.select("path", "line", var.alias("var"), fallback.alias("fallback")).filter(F.col("fallback").isNull() & F.col("var").rlike(r"^[A-Z][A-Z0-9_]*(ADDR|ADDRESS|URL|URI|HOST|HOSTNAME|ENDPOINT|DSN|BROKERS?|TOPIC|QUEUE)$"))
    declared = key_trees(swept).select(F.explode(F.array_distinct(F.transform(F.array("key", "leaf"), T.shouty))).alias("var")).distinct()
    missing = wanted.join(declared, "var", "left_anti")
    return missing.select("path", F.concat(F.lit("read but not declared: "), "var").alias("detail"), "line").withColumn("subject", F.col("path")).select("subject", "detail", "path", "line")


def extract(files: DataFrame, services: DataFrame | None = None, hosts: DataFrame | None = None, wrappers: DataFrame | None = None, bindings: DataFrame | None = None, scopes: tuple[str, ...] = (), lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sightings and gaps of a corpus (``path, text``), with services and hosts as given, or as the corpus declares them.

    ``wrappers`` (``symbol, family, rel``) are confirmed project wrappers, ``bindings``
    (``queue, exchange``) the exchanges of queues; ``scopes`` bounds the sweep to some folders.
    ``lines`` are those of all files with the two after each, where they have been split already.
    """
    from ..sources import corpus
    from ..sources.keys import key_trees
    from . import receivers as R
    from . import signatures as S

    inside = reduce(lambda a, b: a | b, (F.col("path").startswith(s) for s in scopes)) if scopes else F.lit(True)
    own = ~corpus.is_excluded(F.col("path"))
    swept = files.filter(own) if lines is not None else kept(spread(files.filter(own)))
    every = lines.filter(own) if lines is not None else kept(corpus.split_lines(swept, 2))
    if services is None or hosts is None:
        own_services, own_hosts = surroundings(swept, every)
        services, hosts = own_services if services is None else services, own_hosts if hosts is None else hosts
    lines = every.filter(inside)
    families = kept(S.gated(every))
    hits = kept(S.sweep(lines, open_families=families))
    bare = R.bare_calls(lines, R.receivers(lines), hits.filter(F.col("rel").isin(*MESSAGES)))
    hits = hits.unionByName(bare.join(F.broadcast(families), "family", "left_semi"))
    if wrappers is not None:
        hits = S.with_wrappers(lines, hits, wrappers)
    owned = kept(corpus.owners(swept.select("path"), services))
    # the values of all files may resolve a name in scope
    config = kept(key_trees(swept))
    homes = owned.select("path", F.col("service_id").alias("home")).filter("home is not null")
    resolved = kept(ladder(S.real_clients(hits), kept(V.definitions(every)), config, homes))
    by_path, no_route = path_calls(resolved, every, owned)
    served = grpc_calls(resolved, every, owned)
    named = resolved.filter(~((F.col("rel") == "http") & F.coalesce(F.col("value").startswith("/"), F.lit(False))))
    # a stub that names its contract is resolved by that; others by their address
    named = named.filter(~((F.col("rel") == "grpc") & S.first_of(F.col("text"), S.STUBS).isNotNull()))
    targets = target(named, hosts)
    gaps = gaps_of(targets, owned).unionByName(no_route).unionByName(undeclared_variables(swept.filter(inside), lines))
    if bindings is not None:
        queues = targets.filter("family = 'rabbit' and rel = 'sub' and gap is null").withColumn("queue", F.col("object")).drop("object", "label", "gap")
        bound = bound_exchange(queues, bindings)
        gaps = gaps.unionByName(gaps_of(bound, owned))
        targets = targets.filter("not (family = 'rabbit' and rel = 'sub' and gap is null)").unionByName(bound.withColumn("gap", F.lit(None).cast("string")).select(*targets.columns))
    service = owned.select("path", F.col("service_id").alias("actor")).filter("actor is not null")
    plain = lambda df, rel, object_, label: df.join(service, "path").select("actor", rel.alias("rel"), object_.alias("object"), F.lit(label).alias("label"), F.lit("CODE").alias("tag"), "path", "line", F.lit(None).cast("string").alias("note"))
    vendors = plain(vendor_calls(lines.filter(~corpus.is_test(F.col("path")))), F.lit("http"), F.col("vendor"), "-")
    streams = plain(S.stream_bindings(config.filter(inside)), F.col("rel"), F.col("channel"), "-")
    fanned = S.iac_subscriptions(lines).select(F.col("topic").alias("actor"), F.lit("pub").alias("rel"), F.col("queue").alias("object"), F.lit("-").alias("label"), F.lit("CODE").alias("tag"), "path", "line", F.lit(None).cast("string").alias("note"))
    seen = reduce(DataFrame.unionByName, [edges_of(targets, owned), by_path, served, vendors, streams, fanned])
    return seen, gaps


#: Vendors whose SDK names the external service that is called.
VENDORS = {"stripe": r"\bstripe\.\w+\.\w+\(|\bnew Stripe\(", "openai": r"\bOpenAI\(", "anthropic": r"\bAnthropic\(", "gemini": r"\bGenerativeAI\(|\bgenai\.Client\(", "twilio": r"\btwilio\.\w+|\bnew Twilio\(", "sendgrid": r"\bsgMail\.|SendGridAPIClient\("}


def vendor_calls(lines: DataFrame) -> DataFrame:
    """Call sites of vendor SDKs: ``vendor, path, line``; each is an external node named after the vendor."""
    each = F.array(*(F.when(T.matches(F.col("text"), p), F.lit(v)) for v, p in VENDORS.items()))
    return lines.filter(T.may_match(F.col("text"), *VENDORS.values())).select("path", "line", F.explode(each).alias("vendor")).filter("vendor is not null")


def optional_label(label: Column, text: Column) -> Column:
    """The label of a backend that a flag switches on, marked as optional."""
    guarded = text.rlike(r"(?i)\bif\b.*\b(enable|use|with)[A-Za-z_]*\b")
    return F.when(guarded, F.concat(F.lit("optional: "), label)).otherwise(label)
