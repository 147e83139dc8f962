"""Cycles and chains without enumerating paths: strongly connected components, condensation, longest chains.

All rounds are equi-joins and aggregates over pairs of nodes, written to the shared
folder between rounds, so that plans stay short and a lost executor repeats a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def _proper(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").filter("src <> dst").distinct()


def trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs between nodes that have both a way in and a way out, until none is left to drop.

    What goes lies on no cycle.  Takes as many rounds as the longest chain that hangs on the cycles.
    """
    pairs = kept(_proper(pairs))
    before = pairs.count()
    while before:
        inner = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        pairs = kept(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        after = pairs.count()
        if after == before:
            break
        before = after
    return pairs


def _spread(pairs: DataFrame, marks: DataFrame, least: bool) -> DataFrame:
    """``id, mark`` carried along the pairs to a fixpoint: the least mark that reaches a node, or whether any does."""
    state = kept(marks)
    while True:
        came = pairs.join(state, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "mark")
        if not least:  # marks go on only between nodes that share them
            came = came.join(pairs.select(F.col("dst").alias("id"), F.col("colour").alias("mark")).distinct(), ["id", "mark"], "left_semi")
        new = kept(state.unionByName(came).groupBy("id").agg(F.min("mark").alias("mark")))
        changed = new.join(state.withColumnRenamed("mark", "old"), "id", "left").filter("old is null or mark < old")
        if changed.isEmpty():
            return new
        state = new


def strongly_connected(pairs: DataFrame) -> DataFrame:
    """Components of two nodes or more: ``id, component``, the component's smallest node.

    ``pairs`` has ``src, dst``.  Each round trims what lies on no cycle, colours every
    node with the smallest that reaches it, and walks back from the nodes that have their own colour,
    inside it: what they reach and are reached by is a component.  The rest, with its
    pairs inside one colour, goes on to the next round.
    """
    found, rest = [], trimmed(pairs)
    while not rest.isEmpty():
        nodes = rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colours = _spread(rest, nodes.withColumn("mark", F.col("id")), True)
        # components lie within a colour
        inside = rest.join(colours.select(F.col("id").alias("src"), F.col("mark").alias("colour")), "src").join(colours.select(F.col("id").alias("dst"), F.col("mark").alias("other")), "dst").filter("colour = other")
        inside = kept(inside.select("src", "dst", "colour"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "colour")
        roots = colours.filter("id = mark").join(inside.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
        members = _spread(back, roots, False)
        sized = members.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.append(kept(members.join(sized, "mark", "left_semi").select("id", F.col("mark").alias("component"))))
        done = members.select("id")
        left = inside.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti")
        rest = trimmed(left)
    if not found:
        return pairs.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def condensation(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs between components, a node without one standing for itself: ``src, dst``, free of cycles."""
    out = _proper(pairs)
    for end in ("src", "dst"):
        out = out.join(components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c")), end, "left").withColumn(end, F.coalesce(f"{end}_c", end)).drop(f"{end}_c")
    return _proper(out)


def longest_chains(pairs: DataFrame) -> DataFrame:
    """Hops of the longest chain from each node of a graph without cycles: ``id, depth``.

    Level by level from the ends: as many rounds as the longest chain.  Nodes that reach a
    cycle have no row.
    """
    pairs = kept(_proper(pairs))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    done = kept(nodes.join(pairs.select(F.col("src").alias("id")), "id", "left_anti").withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        # nodes all of whose successors are done
        open_ = pairs.join(done.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"))
        new = kept(nodes.join(done, "id", "left_anti").join(open_, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return done
        done = kept(done.unionByName(new))


def _grown(pairs: DataFrame, starts: DataFrame, hops: int, beam: int | None) -> DataFrame:
    """Simple paths by hop from each start: ``start, hops``; with ``beam`` only so many for each start and end."""
    paths = starts.select(F.col("id").alias("start"), F.array("id").alias("nodes"), F.col("id").alias("at"))
    found = starts.select(F.col("id").alias("start"), F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        paths = paths.join(pairs, F.col("at") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        paths = paths.select("start", F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("at"))
        if beam:
            w = Window.partitionBy("start", "at").orderBy(F.xxhash64("nodes"), "nodes")
            paths = paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= beam).drop("rank")
        paths = kept(paths)
        found = found.unionByName(paths.select("start", F.lit(hop).alias("hops")).distinct())
    return found.groupBy("start").agg(F.max("hops").alias("hops"))


def chain_depths(pairs: DataFrame, most: int = 6, beam: int = 4) -> DataFrame:
    """Hops of the longest simple path from each node that has a way out, at most ``most``: ``start, depth``.

    Exact.  A node without a walk of ``most`` hops reaches no cycle, so its longest walk is its
    longest path: ``most`` semi-joins.  For the others a few paths for each pair of ends are
    tried; one of ``most`` hops is proof.  In dense graphs that settles all; the starts that are
    left, in sparse surroundings, have all their paths enumerated.
    """
    pairs = kept(_proper(pairs))
    walks, level = None, pairs.select(F.col("src").alias("id")).distinct()
    for hop in range(1, most + 1):
        level = kept(level if hop == 1 else pairs.join(level.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct())
        here = level.withColumn("depth", F.lit(hop))
        walks = here if walks is None else walks.unionByName(here)
    far = level
    near = walks.join(far, "id", "left_anti").groupBy(F.col("id").alias("start")).agg(F.max("depth").alias("depth"))
    if far.isEmpty():
        return near
    proven = kept(_grown(pairs, far, most, beam).filter(F.col("hops") == most).select("start"))
    rest = kept(far.join(proven.withColumnRenamed("start", "id"), "id", "left_anti"))
    out = near.unionByName(proven.withColumn("depth", F.lit(most)))
    if not rest.isEmpty():
        out = out.unionByName(_grown(pairs, rest, most, None).select("start", F.col("hops").alias("depth")))
    return out


def shortest_cycles(pairs: DataFrame, components: DataFrame, most: int = 6) -> DataFrame:
    """A shortest cycle through the smallest node of each component: ``component, nodes``; null beyond ``most`` hops.

    Breadth first from that node inside its component, one path kept for each node reached.
    """
    member = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
    inside = kept(_proper(pairs).join(member("src"), "src").join(member("dst"), "dst").filter("src_c = dst_c").select("src", "dst", F.col("src_c").alias("component")))
    roots = components.select("component").distinct()
    paths = roots.select("component", F.col("component").alias("at"), F.array("component").alias("nodes"))
    reached, closed = paths.select("component", "at"), None
    for _ in range(most):
        step = paths.join(inside.withColumnRenamed("src", "at"), ["component", "at"])
        ends = step.filter("dst = component").groupBy("component").agg(F.min("nodes").alias("nodes"))
        closed = ends if closed is None else closed.unionByName(ends.join(closed, "component", "left_anti"))
        closed = kept(closed)
        new = step.join(reached.withColumnRenamed("at", "dst"), ["component", "dst"], "left_anti").join(closed, "component", "left_anti")
        paths = kept(new.groupBy("component", F.col("dst").alias("at")).agg(F.min(F.array_append("nodes", F.col("dst"))).alias("nodes")))
        reached = kept(reached.unionByName(paths.select("component", "at")))
    return roots.join(closed, "component", "left")
