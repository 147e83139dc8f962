"""Design review: twelve rules over the ledger, each one query, and the health line.

A finding has ``id, severity, finding, participants, evidence``; evidence are
edge keys, so each finding can be traced to its receipts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SYNC
from ..sources.shared import kept
from . import components, graph

_EVIDENCE = "array<struct<actor:string,rel:string,object:string>>"


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 1).when(severity == "med", 2).when(severity == "low", 3).otherwise(4)


def _key(actor, rel, object_) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.col(x)
    return F.struct(c(actor).alias("actor"), c(rel).alias("rel"), c(object_).alias("object"))


def _finding(df: DataFrame, rule: str, severity: str, text: Column, participants: Column, evidence: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("id"), F.lit(severity).alias("severity"), text.alias("finding"), participants.alias("participants"), evidence.cast(_EVIDENCE).alias("evidence"))


def t1_sync_cycle(edges: DataFrame, most: int = 6) -> DataFrame:
    found = graph.cycles(edges, ("http", "grpc", "gql"), most)
    ring = F.concat(F.col("nodes"), F.slice("nodes", 1, 1))
    steps = F.transform(F.sequence(F.lit(1), F.size("nodes")), lambda i: _key(F.element_at(ring, i), F.lit("sync"), F.element_at(ring, i + 1)))
    return _finding(found, "T1", "high", F.concat(F.lit("sync cycle "), F.array_join(ring, " → ")), F.col("nodes"), steps)


def t1_sync_component(edges: DataFrame) -> DataFrame:
    """T1 by strongly connected components: one finding for all cycles among the same services.

    For ledgers whose simple cycles are too many to list.  The evidence is a shortest cycle through the
    component's first service.
    """
    calls = _calls(edges, ("http", "grpc", "gql"))
    found = kept(components.strongly_connected(calls))
    members = found.groupBy("component").agg(F.array_sort(F.collect_set("id")).alias("members"))
    ring = components.shortest_cycles(calls, found)
    shown = members.join(ring, "component").withColumn("closed", F.concat("nodes", F.slice("nodes", 1, 1)))
    steps = F.transform(F.sequence(F.lit(1), F.size("nodes")), lambda i: _key(F.element_at("closed", i), F.lit("sync"), F.element_at("closed", i + 1)))
    text = F.concat(F.lit("sync cycles among "), F.size("members").cast("string"), F.lit(" services, such as "), F.coalesce(F.array_join("closed", " → "), F.lit("one of more than 6 hops")))
    return _finding(shown, "T1", "high", text, F.col("members"), F.coalesce(F.when(F.col("nodes").isNotNull(), steps), F.array().cast(_EVIDENCE)))


def t2_event_then_callback(edges: DataFrame) -> DataFrame:
    sub = edges.filter("rel = 'sub'").select(F.col("actor").alias("x"), F.col("object").alias("t")).distinct()
    pub = edges.filter("rel = 'pub'").select(F.col("actor").alias("p"), F.col("object").alias("t")).distinct()
    call = edges.filter("rel in ('http', 'grpc')").select(F.col("actor").alias("x"), F.col("object").alias("p")).groupBy("x", "p").agg(F.lit(1).alias("one")).drop("one")
    found = call.join(sub, "x").join(pub, ["p", "t"]).filter("x <> p")
    return _finding(found, "T2", "med", F.concat("x", F.lit(" reads "), "t", F.lit(" and calls its producer "), "p"), F.array("x", "p"), F.array(_key("x", F.lit("sub"), "t"), _key("x", F.lit("call"), "p")))


def t3_shared_store(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    db = nodes.filter("kind = 'db'").select("id")
    users = edges.filter("rel = 'uses'").join(db, F.col("object") == F.col("id"), "left_semi").groupBy("object").agg(F.array_sort(F.collect_set("actor")).alias("users"))
    found = users.filter(F.size("users") >= 2)
    return _finding(found, "T3", "high", F.concat("object", F.lit(" is used by "), F.array_join("users", ", ")), F.col("users"), F.transform("users", lambda u: _key(u, F.lit("uses"), F.col("object"))))


def t4_orphan_channel(edges: DataFrame, scopes_all: bool = True) -> DataFrame:
    """Only meaningful for a ledger of all scopes; otherwise no findings."""
    per = edges.filter("rel in ('pub', 'sub')").groupBy("object").agg(F.count_if(F.col("rel") == "pub").alias("pubs"), F.count_if(F.col("rel") == "sub").alias("subs"), F.array_sort(F.collect_set("actor")).alias("who"))
    found = per.filter(((F.col("pubs") == 0) | (F.col("subs") == 0)) & F.lit(scopes_all))
    rel = F.when(F.col("subs") == 0, "pub").otherwise("sub")
    return _finding(found, "T4", "low", F.concat("object", F.when(F.col("subs") == 0, " has no consumer").otherwise(" has no producer")), F.col("who"), F.transform("who", lambda w: _key(w, rel, F.col("object"))))


def _calls(edges: DataFrame, rels: tuple[str, ...]) -> DataFrame:
    return edges.filter(F.col("rel").isin(*rels)).select(F.col("actor").alias("src"), F.col("object").alias("dst"))


def sync_depth(edges: DataFrame, most: int = 6) -> DataFrame:
    """Longest simple path over sync edges by its first node, at most ``most``: ``start, depth``."""
    return components.chain_depths(_calls(edges, SYNC), most)


def t5_deep_sync_chain(edges: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    found = sync_depth(edges, most).filter(F.col("depth") >= least)
    depth = F.when(F.col("depth") >= most, F.lit(f">={most}")).otherwise(F.col("depth").cast("string"))
    return _finding(found, "T5", "med", F.concat(F.lit("sync chain of "), depth, F.lit(" hops from "), "start"), F.array("start"), F.array())


def t6_hub(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Services (nodes of kind ``svc``) that hold a large part of all edges."""
    total = edges.agg(F.count(F.lit(1)).alias("n"))
    degree = edges.select(F.explode(F.array("actor", "object")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    degree = degree.join(nodes.filter("kind = 'svc'").select(F.col("id").alias("node")), "node", "left_semi")
    found = degree.join(F.broadcast(total)).filter((F.col("degree") >= 6) & (F.col("degree") * 10 >= F.col("n") * 3))
    return _finding(found, "T6", "med", F.concat("node", F.lit(" has degree "), F.col("degree").cast("string")), F.array("node"), F.array())


def t7_chatty_pair(edges: DataFrame, least: int = 4) -> DataFrame:
    per = edges.filter(F.col("rel").isin(*SYNC)).groupBy("actor", "object").agg(F.count_distinct("label").alias("labels"), F.min("rel").alias("rel"))
    found = per.filter(F.col("labels") >= least)
    return _finding(found, "T7", "low", F.concat("actor", F.lit(" makes "), F.col("labels").cast("string"), F.lit(" different calls to "), "object"), F.array("actor", "object"), F.array(_key("actor", "rel", "object")))


def t8_hard_wired(edges: DataFrame) -> DataFrame:
    """Calls that stand at one place: by the receipts, or where edges come without them by ``single``."""
    once = F.col("single") if "single" in edges.columns else F.aggregate("receipts", F.lit(0), lambda n, r: n + F.size(r["lines"])) == 1
    found = edges.filter(F.col("rel").isin(*SYNC) & (F.col("tag") == "CODE") & once)
    return _finding(found, "T8", "low", F.concat("actor", F.lit(" names "), "object", F.lit(" in code")), F.array("actor"), F.array(_key("actor", "rel", "object")))


def t9_unkeyed_event(edges: DataFrame) -> DataFrame:
    busy = edges.filter("rel = 'sub'").groupBy(F.col("object").alias("t")).agg(F.count_distinct("actor").alias("consumers")).filter("consumers >= 2")
    found = edges.filter((F.col("rel") == "pub") & ~F.coalesce(F.col("label"), F.lit("-")).contains("key=")).join(busy, F.col("object") == F.col("t"))
    return _finding(found, "T9", "info", F.concat("actor", F.lit(" writes "), "object", F.lit(" without a key for "), F.col("consumers").cast("string"), F.lit(" consumers")), F.array("actor"), F.array(_key("actor", F.lit("pub"), "object")))


def t10_ping_pong(edges: DataFrame) -> DataFrame:
    pub = edges.filter("rel = 'pub'").select(F.col("actor").alias("p"), F.col("object").alias("t")).distinct()
    sub = edges.filter("rel = 'sub'").select(F.col("actor").alias("c"), F.col("object").alias("t")).distinct()
    step = pub.join(sub, "t").filter("p <> c").select("p", "c", "t")
    back = step.select(F.col("p").alias("c"), F.col("c").alias("p"), F.col("t").alias("u"))
    found = step.filter("p < c").join(back, ["p", "c"]).filter("t <> u")
    return _finding(found, "T10", "info", F.concat("p", F.lit(" and "), "c", F.lit(" answer each other over "), "t", F.lit(" and "), "u"), F.array("p", "c"), F.array(_key("p", F.lit("pub"), "t"), _key("c", F.lit("sub"), "t"), _key("c", F.lit("pub"), "u"), _key("p", F.lit("sub"), "u")))


def t11_unowned_contract(nodes: DataFrame, edges: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """``ref`` nodes, and targets of grpc and http edges without a contract; external targets are left out.

    ``contracts`` has ``rel`` (grpc: a .proto service, http: an API description) and
    the ``name`` of the node that it describes; without it only ``ref`` nodes are found.
    """
    refs = nodes.filter("kind = 'ref'").select("id")
    outside = nodes.filter("kind = 'ext'").select("id")
    found = refs
    if contracts is not None:
        called = edges.filter("rel in ('grpc', 'http')").select("rel", F.col("object").alias("id")).distinct().join(outside, "id", "left_anti")
        open_ = called.join(contracts.select("rel", F.col("name").alias("id")), ["rel", "id"], "left_anti")
        found = refs.unionByName(open_.select("id"))
    found = found.distinct()
    return _finding(found, "T11", "info", F.concat("id", F.lit(" has no contract in scope")), F.array("id"), F.array())


def t12_inference_debt(edges: DataFrame) -> DataFrame:
    share = edges.agg(F.count_if(F.col("tag") != "CODE").alias("k"), F.count(F.lit(1)).alias("n"))
    return _finding(share.filter("5 * k > n"), "T12", "info", F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" edges are not from code")), F.array().cast("array<string>"), F.array())


def findings(nodes: DataFrame, edges: DataFrame, scopes_all: bool = True, cycle_hops: int | None = 6, contracts: DataFrame | None = None) -> DataFrame:
    """All findings of the twelve rules; without ``cycle_hops`` cycles are told by component, not one by one."""
    cyclic = t1_sync_component(edges) if cycle_hops is None else t1_sync_cycle(edges, cycle_hops)
    all_ = reduce(DataFrame.unionByName, [cyclic, t2_event_then_callback(edges), t3_shared_store(nodes, edges), t4_orphan_channel(edges, scopes_all), t5_deep_sync_chain(edges), t6_hub(nodes, edges), t7_chatty_pair(edges), t8_hard_wired(edges), t9_unkeyed_event(edges), t10_ping_pong(edges), t11_unowned_contract(nodes, edges, contracts), t12_inference_debt(edges)])
    return all_


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(severity_rank(F.col("severity")), F.expr("cast(substring(id, 2) as int)"), "finding")


def disclosed(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings with ``inferred``: whether an edge of their evidence is not from code."""
    weak = edges.filter("tag <> 'CODE'").select("actor", "rel", "object").distinct().withColumn("weak", F.lit(True))
    each = found.select("*", F.explode_outer("evidence").alias("e"))
    each = each.withColumn("actor", F.col("e.actor")).withColumn("rel", F.col("e.rel")).withColumn("object", F.col("e.object"))
    joined = each.join(weak, ["actor", "rel", "object"], "left")
    return joined.groupBy("id", "severity", "finding", "participants", "evidence").agg(F.max(F.coalesce("weak", F.lit(False))).alias("inferred"))


def warned(found: DataFrame) -> DataFrame:
    """Nodes named in a high or medium finding."""
    return found.filter("severity in ('high', 'med')").select(F.explode("participants").alias("id")).distinct()


def health(nodes: DataFrame, edges: DataFrame, found: DataFrame, most: int = 6) -> DataFrame:
    """One row of totals over ledger and findings."""
    kinds = nodes.agg(F.count_if(F.col("kind") == "svc").alias("services"), F.count_if(F.col("kind") == "ref").alias("referenced"))
    evidence = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.round(100 * F.count_if(F.col("tag") == "CODE") / F.count(F.lit(1))), F.lit(0)).cast("bigint").alias("code_percent"))
    depth = sync_depth(edges, most).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("bigint").alias("sync_depth"))
    per = found.agg(
        F.count_if(F.col("id") == "T1").alias("cycles"),
        F.count_if(F.col("id") == "T3").alias("shared_stores"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "med", "low", "info")),
    )
    return kinds.join(evidence).join(depth).join(per)


def health_line(row: DataFrame) -> DataFrame:
    """The totals as one line of text."""
    return row.select(F.format_string("%d services (+%d referenced) · %d edges (%d%% CODE) · sync depth %d · cycles %d · shared stores %d · %d high / %d med / %d low / %d info", "services", "referenced", "edges", "code_percent", "sync_depth", "cycles", "shared_stores", "high", "med", "low", "info").alias("line"))


def to_be(edges: DataFrame, proposal: DataFrame) -> DataFrame:
    """As-is edges with a proposal's ``op`` (added or removed) applied."""
    gone = proposal.filter("op = 'removed'").select("actor", "rel", "object").distinct()
    added = proposal.filter("op = 'added'").select(*(F.col(c) if c in proposal.columns else F.lit(None).alias(c) for c in edges.columns))
    return edges.join(gone, ["actor", "rel", "object"], "left_anti").select(*edges.columns).unionByName(added)
