"""Graph operators: orientations, bounded closures, simple paths, and the lenses built on them.

All take the ledger's ``nodes`` and ``edges`` and return DataFrames.  Steps are
equi-joins over distinct pairs; the number of steps is bounded, so no operator
collects a frontier.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import EDGE_KEY, STORES, SYNC
from ..sources.shared import kept


@dataclass
class View:
    """A lens' selection: nodes (with a class or ring) and edges."""

    nodes: DataFrame
    edges: DataFrame


def flow(edges: DataFrame) -> DataFrame:
    """Edges with data-flow ends ``src, dst``: a subscription runs from the channel to its reader."""
    sub = F.col("rel") == "sub"
    return edges.withColumn("src", F.when(sub, F.col("object")).otherwise(F.col("actor"))).withColumn("dst", F.when(sub, F.col("actor")).otherwise(F.col("object")))


def dependency(edges: DataFrame) -> DataFrame:
    """Edges with ``dependent, dependency``: a channel depends on its producer."""
    pub = F.col("rel") == "pub"
    return edges.withColumn("dependent", F.when(pub, F.col("object")).otherwise(F.col("actor"))).withColumn("dependency", F.when(pub, F.col("actor")).otherwise(F.col("object")))


def service_dependencies(edges: DataFrame) -> DataFrame:
    """Distinct ``dependent, dependency`` pairs with channels contracted: a reader depends on the writers."""
    direct = edges.filter(~F.col("rel").isin("pub", "sub")).select(F.col("actor").alias("dependent"), F.col("object").alias("dependency"))
    reads = edges.filter("rel = 'sub'").select(F.col("actor").alias("dependent"), F.col("object").alias("channel")).distinct()
    writes = edges.filter("rel = 'pub'").select(F.col("actor").alias("dependency"), F.col("object").alias("channel")).distinct()
    through = reads.join(writes, "channel").select("dependent", "dependency")
    return direct.unionByName(through).filter("dependent <> dependency").distinct()


def _rings(pairs: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes reached over ``pairs(from, to)`` from ``start(id)`` and the least number of hops, 1 to ``hops``.

    The pairs are written once.  A hop is one join and one aggregate: every node
    has a pair with itself that costs nothing, so what is reached stays.
    """
    ids = pairs.select(F.explode(F.array("from", "to")).alias("id")).unionByName(start.select("id")).distinct()
    steps = kept(pairs.select("from", "to", F.lit(1).alias("cost")).unionByName(ids.select(F.col("id").alias("from"), F.col("id").alias("to"), F.lit(0).alias("cost"))).groupBy("from", "to").agg(F.min("cost").alias("cost")))
    seen = start.select("id").distinct().withColumn("ring", F.lit(0))
    for hop in range(1, hops + 1):
        # only what the last hop has reached can go on; the rest steps to itself
        step = seen.join(steps, (seen["id"] == steps["from"]) & ((F.col("cost") == 0) | (F.col("ring") == hop - 1)))
        seen = step.select(F.col("to").alias("id"), (F.col("ring") + F.col("cost")).alias("ring")).groupBy("id").agg(F.min("ring").alias("ring"))
    return seen.filter("ring > 0")


def impact(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """Who is affected when the start nodes break: ``node, ring``.

    A channel as the start is a dependency of its readers.
    """
    pairs = service_dependencies(edges).select(F.col("dependency").alias("from"), F.col("dependent").alias("to"))
    readers = edges.filter("rel = 'sub'").select(F.col("object").alias("from"), F.col("actor").alias("to"))
    return _rings(pairs.unionByName(readers).distinct(), start, hops).select(F.col("id").alias("node"), "ring")


def deps(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """What the start nodes need, channels being conduits: ``node, ring``."""
    pairs = service_dependencies(edges).select(F.col("dependent").alias("from"), F.col("dependency").alias("to"))
    return _rings(pairs, start, hops).select(F.col("id").alias("node"), "ring")


def impact_reasons(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """For each affected service: ring and, ordered, what it consumes or calls of the ring before."""
    rings = impact(edges, start, hops).unionByName(start.select(F.col("id").alias("node"), F.lit(0).alias("ring")))
    reads = edges.filter("rel = 'sub'").select(F.col("actor").alias("node"), F.col("object").alias("channel"))
    writes = edges.filter("rel = 'pub'").select(F.col("actor").alias("source"), F.col("object").alias("channel"))
    consumed = reads.join(writes, "channel").select("node", "source", F.concat(F.lit("consumes "), F.col("channel")).alias("why"))
    called = edges.filter(~F.col("rel").isin("pub", "sub")).select(F.col("actor").alias("node"), F.col("object").alias("source"), F.concat(F.lit("calls "), F.col("object")).alias("why"))
    before = rings.select(F.col("node").alias("source"), F.col("ring").alias("above"))
    why = consumed.unionByName(called).filter("node <> source").distinct().join(before, "source").join(rings.filter("ring > 0"), "node").filter("above = ring - 1")
    return why.groupBy("node", "ring").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("reasons"))


def focus(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Edges of the subject, and the far ends of its channels."""
    s = start.select(F.col("id").alias("s"))
    incident = edges.join(F.broadcast(s), (F.col("actor") == F.col("s")) | (F.col("object") == F.col("s")), "left_semi")
    mine = edges.join(F.broadcast(s), F.col("actor") == F.col("s"), "left_semi")
    read = mine.filter("rel = 'sub'").select(F.col("object").alias("channel")).distinct()
    written = mine.filter("rel = 'pub'").select(F.col("object").alias("channel")).distinct()
    producers = edges.filter("rel = 'pub'").join(read, F.col("object") == F.col("channel"), "left_semi")
    consumers = edges.filter("rel = 'sub'").join(written, F.col("object") == F.col("channel"), "left_semi")
    return incident.unionByName(producers).unionByName(consumers).dropDuplicates(EDGE_KEY)


def channel_steps(edges: DataFrame) -> DataFrame:
    """Distinct ``from, via, to``: a service reads ``from`` and writes ``to``."""
    reads = edges.filter("rel = 'sub'").select(F.col("object").alias("from"), F.col("actor").alias("via"))
    writes = edges.filter("rel = 'pub'").select(F.col("actor").alias("via"), F.col("object").alias("to"))
    return reads.join(writes, "via").filter("`from` <> `to`").select("from", "via", "to").distinct()


def lineage_channels(edges: DataFrame, start: DataFrame, hops: int = 4) -> DataFrame:
    """Channels downstream of the start channels, with the least number of channel steps: ``id, ring``."""
    return _rings(channel_steps(edges).select("from", "to").distinct(), start, hops)


def lineage(edges: DataFrame, start: DataFrame, hops: int = 4) -> DataFrame:
    """Edges from the producers of a channel to its consumers, what those publish, and so on; and calls back upstream.

    Beyond the start channel's own producers, only actors that read a channel of
    the ring before are drawn as producers.
    """
    reached = kept(lineage_channels(edges, start, hops).select("id", "ring").unionByName(start.select("id", F.lit(0).alias("ring"))))
    read = edges.filter("rel = 'sub'").join(reached, F.col("object") == F.col("id")).drop("id", "ring")
    first = edges.filter("rel = 'pub'").join(start, F.col("object") == F.col("id"), "left_semi")
    readers = edges.filter("rel = 'sub'").join(reached, F.col("object") == F.col("id")).select(F.col("actor").alias("reader"), (F.col("ring") + 1).alias("next")).distinct()
    # a reader at a ring publishes onward to channels of the next ring or of one before (a repeat)
    pub = edges.filter("rel = 'pub'").join(reached.filter("ring > 0"), F.col("object") == F.col("id"))
    onward = pub.join(readers.filter(F.col("next") <= hops), (F.col("actor") == F.col("reader")) & (F.col("ring") <= F.col("next")), "left_semi").drop("id", "ring")
    origin = first.select(F.col("actor").alias("p")).distinct()
    back = edges.filter(F.col("rel").isin(*SYNC)).join(origin, F.col("object") == F.col("p"), "left_semi").join(readers, F.col("actor") == F.col("reader"), "left_semi")
    return read.unionByName(first).unionByName(onward).unionByName(back).dropDuplicates(EDGE_KEY)


def simple_paths(edges: DataFrame, start: DataFrame, end: DataFrame | None = None, hops: int = 6, rels: tuple[str, ...] | None = None) -> DataFrame:
    """Simple paths in data-flow direction: ``nodes`` (array), ``hops``, ``sync``.

    With ``end`` only paths that end there; else every path of one to ``hops``
    hops.  The path array guards against cycles.
    """
    picked = edges if rels is None else edges.filter(F.col("rel").isin(*rels))
    pairs = flow(picked).groupBy("src", "dst").agg(F.max(F.col("rel").isin(*SYNC)).alias("call")).filter("src <> dst")
    grown = start.select(F.array("id").alias("nodes"), F.col("id").alias("at"), F.lit(0).alias("hops"), F.lit(True).alias("sync"))
    found = []
    for _ in range(hops):
        if end is not None:
            grown = grown.join(F.broadcast(end.select(F.col("id").alias("z"))), F.col("at") == F.col("z"), "left_anti")
        grown = grown.join(pairs, F.col("at") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        grown = grown.select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("at"), (F.col("hops") + 1).alias("hops"), (F.col("sync") & F.col("call")).alias("sync"))
        found.append(grown)
    all_ = reduce(DataFrame.unionByName, found)
    if end is not None:
        all_ = all_.join(F.broadcast(end.select(F.col("id").alias("z"))), F.col("at") == F.col("z"), "left_semi")
    return all_.select("nodes", "hops", "sync")


def reachable(edges: DataFrame, rels: tuple[str, ...], hops: int) -> DataFrame:
    """Distinct ``a, b``: b is reached from a over the relations within ``hops`` calls."""
    pairs = kept(edges.filter(F.col("rel").isin(*rels)).select(F.col("actor").alias("a"), F.col("object").alias("b")).filter("a <> b").distinct())
    seen = pairs
    steps = pairs.select(F.col("a").alias("m"), F.col("b").alias("n"))
    steps = steps.unionByName(steps.select(F.explode(F.array("m", "n")).alias("m")).distinct().withColumn("n", F.col("m")))
    for _ in range(hops - 1):
        seen = seen.join(steps, F.col("b") == F.col("m")).select("a", F.col("n").alias("b")).distinct()
    return seen


def cycles(edges: DataFrame, rels: tuple[str, ...] = ("http", "grpc", "gql"), most: int = 6) -> DataFrame:
    """Simple cycles of at most ``most`` calls, each once, from its smallest node: ``nodes, hops``."""
    pairs = edges.filter(F.col("rel").isin(*rels)).select(F.col("actor").alias("src"), F.col("object").alias("dst")).filter("src <> dst").distinct()
    grown = pairs.select(F.col("src").alias("root"), F.array("src").alias("nodes"), F.col("src").alias("at"), F.lit(0).alias("hops")).distinct()
    found = []
    for _ in range(most):
        step = grown.join(pairs, F.col("at") == F.col("src")).withColumn("hops", F.col("hops") + 1)
        found.append(step.filter("dst = root").select("nodes", "hops"))
        step = step.filter((F.col("dst") > F.col("root")) & ~F.array_contains("nodes", F.col("dst")))
        grown = step.select("root", F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("at"), "hops")
    return reduce(DataFrame.unionByName, found)


def data(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Uses of stores, with the number of users of each and whether it is shared."""
    stores = nodes.filter(F.col("kind").isin(*STORES)).select("id", "kind")
    uses = edges.filter("rel = 'uses'").join(stores, F.col("object") == F.col("id")).select("actor", "object", "kind", "label")
    users = uses.groupBy("object").agg(F.count_distinct("actor").alias("users"))
    return uses.join(users, "object").withColumn("shared", F.col("users") >= 2)


def overview(edges: DataFrame) -> DataFrame:
    return edges.filter("rel <> 'dep'")


def clusters(nodes: DataFrame, by: str = "path") -> DataFrame:
    """Nodes with their cluster: the top directory of the binding, or the first part of the id."""
    key = T.top_dir(F.get("receipts", F.lit(0))["path"]) if by == "path" else F.split("id", "[.-]")[0]
    return nodes.withColumn("cluster", F.coalesce(key, F.split("id", "[.-]")[0]))


def cluster_summary(nodes: DataFrame, by: str = "path") -> DataFrame:
    """Nodes per cluster and kind, external services collapsed to a count."""
    return clusters(nodes, by).groupBy("cluster").agg(
        F.count_if(F.col("kind") != "ext").alias("members"),
        F.count_if(F.col("kind") == "ext").alias("external"),
        F.concat(F.count_if(F.col("kind") == "ext").cast("string"), F.lit(" external APIs")).alias("collapsed"),
    )


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and relabelled edges: ``actor, rel, object, old_label, new_label, change``.

    An added and a removed label of the same (actor, rel, object) are one
    relabelled edge if there is exactly one of each.
    """
    both = old.select(*EDGE_KEY, F.lit(True).alias("was")).distinct().unionByName(new.select(*EDGE_KEY, F.lit(False).alias("was")).distinct())
    # a key on both sides is unchanged; grouping treats null labels as equal
    sides = both.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("n"), F.max("was").alias("was")).filter("n = 1").drop("n")
    per = sides.groupBy("actor", "rel", "object").agg(F.collect_list(F.struct("was", "label")).alias("all"), F.count_if(F.col("was")).alias("gone"), F.count_if(~F.col("was")).alias("come"))
    swap = (F.col("gone") == 1) & (F.col("come") == 1)
    pick = lambda was: F.get(F.filter("all", lambda x: x["was"] == F.lit(was)), F.lit(0))["label"]
    relabelled = per.filter(swap).select("actor", "rel", "object", pick(True).alias("old_label"), pick(False).alias("new_label"), F.lit("relabelled").alias("change"))
    others = per.filter(~swap).select("actor", "rel", "object", F.explode("all").alias("x"))
    others = others.select("actor", "rel", "object", F.when(F.col("x.was"), F.col("x.label")).alias("old_label"), F.when(~F.col("x.was"), F.col("x.label")).alias("new_label"), F.when(F.col("x.was"), "removed").otherwise("added").alias("change"))
    return relabelled.unionByName(others)


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that the edges touch."""
    ids = edges.select(F.explode(F.array("actor", "object")).alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def stores_only(view_nodes: DataFrame, view_edges: DataFrame, kinds: tuple[str, ...]) -> View:
    """A lens narrowed to edges that touch nodes of some kinds."""
    kept = view_nodes.filter(F.col("kind").isin(*kinds)).select("id")
    # two equi-joins: an edge counts by its object, else by its actor
    by_object = view_edges.join(kept.withColumnRenamed("id", "object"), "object", "left_semi")
    by_actor = view_edges.join(kept.withColumnRenamed("id", "object"), "object", "left_anti").join(kept.withColumnRenamed("id", "actor"), "actor", "left_semi")
    edges = by_object.select(view_edges.columns).unionByName(by_actor.select(view_edges.columns))
    return View(endpoints(view_nodes, edges), edges)


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, CODE edges, inferred edges."""
    ends = edges.select(F.explode(F.array("actor", "object")).alias("id")).agg(F.count_distinct("id").alias("nodes"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("tag") == "CODE").alias("code"), F.count_if(F.col("tag") != "CODE").alias("inferred")).join(F.broadcast(ends))
