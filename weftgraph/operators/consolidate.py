"""Sightings to edges, merging of ledgers, and incremental refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import EDGE_KEY, RECEIPTS
from ..sources.shared import kept


def tag_rank(tag: Column) -> Column:
    """Strength of evidence, strongest first."""
    return F.when(tag == "CODE", 1).when(tag == "INFERENCE", 2).otherwise(3)


def merged_receipts(places: Column) -> Column:
    """Receipts of places ``struct<rank, path, line>`` in order: files in first-seen order, each with its lines.

    The places of a file stand together, unless it shows the edge with evidence of
    different strength; only then its lines are gathered from the whole array.
    """
    lines = lambda some: F.array_distinct(F.transform(some, lambda p: p["line"]))

    def run(p: Column, at: Column, end: Column) -> Column:
        # most files show an edge at one line
        held = F.when(end - at == 1, F.array(F.get(p, at)["line"])).otherwise(lines(F.slice(p, at + 1, end - at)))
        return F.struct(F.get(p, at)["path"].alias("path"), held.alias("lines"))

    def runs(p: Column, starts: Column) -> Column:
        return F.transform(starts, lambda at, k: run(p, at, F.coalesce(F.get(starts, k + 1), F.size(p))))

    def single(p: Column) -> Column:
        return F.transform(p, lambda x: F.struct(x["path"].alias("path"), F.array(x["line"]).alias("lines")))

    def mixed(p: Column, paths: Column) -> Column:
        return F.transform(paths, lambda path: F.struct(path.alias("path"), lines(F.filter(p, lambda x: x["path"] == path)).alias("lines")))

    def both(p: Column, all_: Column, paths: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(all_, i) != F.get(all_, i - 1)))
        return let(starts, lambda s: F.when(F.size(s) == F.size(paths), runs(p, s)).otherwise(mixed(p, paths)))

    def by_path(p: Column) -> Column:
        return let(F.transform(p, lambda x: x["path"]), lambda all_: let(F.array_distinct(all_), lambda q: F.when(F.size(q) == F.size(p), single(p)).otherwise(both(p, all_, q))))

    return let(places, by_path)


def consolidate(sightings: DataFrame) -> DataFrame:
    """One edge per (actor, rel, object, label): strongest tag, all receipts, a note.

    Evidence in code has only notes of such evidence.  Repeated places are dropped before the shuffle's final step.  Receipts are
    ordered by strength of evidence, then path and line.  An edge's places end in
    one row, as its text form is one line; edge_tags, edge_counts and receipt_rows
    are the forms without that limit.

    Rows are sorted by one number instead of four texts, the hash of the key; keys that share
    one (2^-64 a pair) would be told apart by a second hash, and are an error.
    """
    place = F.struct(tag_rank(F.col("tag")).alias("rank"), "path", "line")
    twin = F.xxhash64(F.lit("edge"), *EDGE_KEY)
    hashed = sightings.withColumn("h", F.xxhash64(*EDGE_KEY))
    grouped = hashed.groupBy("h").agg(F.first(F.struct(*EDGE_KEY)).alias("k"), F.min(twin).alias("lo"), F.max(twin).alias("hi"), F.sort_array(F.collect_set(place)).alias("places"), F.min(F.struct(tag_rank(F.col("tag")).alias("rank"), "tag")).alias("best"), F.min("note").alias("note"), F.min(F.when(F.col("tag") == "CODE", F.col("note"))).alias("certain"))
    note = F.when(F.col("best.tag") != "CODE", F.col("note")).otherwise(F.col("certain"))
    label = F.when(F.col("lo") == F.col("hi"), F.col("k.label")).otherwise(F.raise_error(F.lit("two edges of one hash")))
    return grouped.select("k.actor", "k.rel", "k.object", label.alias("label"), F.col("best.tag").alias("tag"), merged_receipts(F.col("places")).alias("receipts"), note.alias("note"))


def receipt_rows(sightings: DataFrame) -> DataFrame:
    """Receipts as rows ``actor, rel, object, label, path, line``, each place once.

    The form for edges with more places than a row should hold: nothing is
    gathered per edge, so an edge seen everywhere is spread over all tasks.
    """
    return sightings.select(*EDGE_KEY, "path", "line").distinct()


def edge_counts(sightings: DataFrame) -> DataFrame:
    """Edges with the number of places they were seen at: the full-scale form of consolidate()."""
    return sightings.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("sightings"), F.min("path").alias("first_path"), F.min(tag_rank(F.col("tag"))).alias("rank"))


def edge_tags(sightings: DataFrame, single: bool = False) -> DataFrame:
    """Edges with their strongest tag and its note, without receipts: what the lenses need.

    Tags and notes are first grouped as they are, which a hash table can do, and
    the few that an edge has are then compared.  With ``single`` there is a column of that
    name: whether the edge was seen at one place only, by the hashes of its places.
    """
    place = F.xxhash64("path", "line")
    # the sum of the counts keeps the two steps apart: least texts of all rows at once would take a sort
    each = sightings.groupBy(*EDGE_KEY, "tag", "note").agg(F.count(F.lit(1)).alias("n"), *([F.min(place).alias("lo"), F.max(place).alias("hi")] if single else []))
    best = each.groupBy(*EDGE_KEY).agg(F.min(tag_rank(F.col("tag"))).alias("rank"), F.min("note").alias("note"), F.min(F.when(F.col("tag") == "CODE", F.col("note"))).alias("certain"), F.sum("n").alias("n"), *([(F.min("lo") == F.max("hi")).alias("single")] if single else [])).filter("n > 0")
    tag = F.when(F.col("rank") == 1, "CODE").when(F.col("rank") == 2, "INFERENCE").otherwise("UNVERIFIED")
    return best.select(*EDGE_KEY, tag.alias("tag"), F.when(F.col("rank") > 1, F.col("note")).otherwise(F.col("certain")).alias("note"), *(["single"] if single else []))


def fold_labels(sightings: DataFrame) -> DataFrame:
    """Sightings without a label join the only labelled edge of the same (actor, rel, object)."""
    w = Window.partitionBy("actor", "rel", "object")
    labelled = F.when(F.col("label") != "-", F.col("label"))
    lo, hi = F.min(labelled).over(w), F.max(labelled).over(w)
    return sightings.withColumn("label", F.when((F.col("label") == "-") & (lo == hi), lo).otherwise(F.col("label")))


def with_receipts(chosen: DataFrame, sightings: DataFrame) -> DataFrame:
    """The chosen edges of a lens, cut from edges without receipts, with the receipts of their sightings and of no others."""
    keys = kept(chosen.select(*EDGE_KEY).distinct())
    same = [sightings[c].eqNullSafe(keys[c]) for c in EDGE_KEY]
    return consolidate(sightings.join(keys, same, "left_semi"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two edge sets; edges in both have the receipts of both.

    Both are consolidated, so an edge of one side only passes as it is; of those that both have the
    receipts are put together within the row.  Sides without receipts add nothing to those that have some.
    """
    sides = left.select(*EDGE_KEY, "tag", "receipts", "note").unionByName(right.select(*EDGE_KEY, "tag", "receipts", "note"))
    grouped = sides.groupBy(*EDGE_KEY).agg(F.collect_list(F.struct("tag", "receipts", "note")).alias("sides"))
    cited = F.filter("sides", lambda s: F.size(s["receipts"]) > 0)
    grouped = grouped.withColumn("sides", F.when(F.size("sides") > 1, cited).otherwise(F.col("sides"))).withColumn("shared", F.size("sides") > 1).filter(F.size("sides") > 0)
    one = F.col("sides")[0]
    place = lambda s, r, n: F.struct(tag_rank(s["tag"]).alias("rank"), r["path"].alias("path"), n.alias("line"))
    # the same receipts twice are those of one side
    unlike = F.filter("sides", lambda s, i: (i == 0) | (s["tag"] != one["tag"]) | (s["receipts"] != one["receipts"]))
    places = F.flatten(F.transform(unlike, lambda s: F.flatten(F.transform(s["receipts"], lambda r: F.transform(r["lines"], lambda n: place(s, r, n))))))
    receipts = F.when(F.col("shared"), merged_receipts(F.sort_array(places))).otherwise(one["receipts"])
    best = F.array_min(F.transform("sides", lambda s: F.struct(tag_rank(s["tag"]).alias("rank"), s["tag"].alias("tag"))))["tag"]
    least = lambda some: F.array_min(F.transform(some, lambda s: s["note"]))
    note = F.when(best != "CODE", least(F.col("sides"))).otherwise(least(F.filter("sides", lambda s: s["tag"] == "CODE")))
    return grouped.select(*EDGE_KEY, best.alias("tag"), receipts.alias("receipts"), note.alias("note"))


def with_assertions(edges: DataFrame, said: DataFrame) -> DataFrame:
    """Edges plus what somebody said (``actor, rel, object, label, note``), tagged as not verified."""
    stated = said.select(*EDGE_KEY, F.lit("UNVERIFIED").alias("tag"), F.array().cast(RECEIPTS).alias("receipts"), "note")
    known = edges.select(*EDGE_KEY)
    return edges.unionByName(stated.join(known, EDGE_KEY, "left_anti"))


def invalidate(edges: DataFrame, changed: DataFrame, strict: bool = False) -> DataFrame:
    """Edges whose primary receipt, or any with ``strict``, is not in a changed file (``changed.path``)."""
    paths = changed.select("path").distinct()
    if not strict:
        return edges.withColumn("primary", F.get("receipts", F.lit(0))["path"]).join(paths, F.col("primary") == F.col("path"), "left_anti").drop("primary")
    stale = edges.select(*EDGE_KEY, F.explode("receipts").alias("r")).join(paths, F.col("r.path") == F.col("path"), "left_semi").select(*EDGE_KEY).distinct()
    return edges.join(stale, EDGE_KEY, "left_anti")


def refresh(edges: DataFrame, changed: DataFrame, found: DataFrame, strict: bool = False) -> DataFrame:
    """Stale edges dropped, the re-swept sightings of the changed files merged in."""
    return merge(invalidate(edges, changed, strict), consolidate(found))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose content differs between two corpora of ``path, text``."""
    a = old.select("path", F.sha2("text", 256).alias("a"))
    b = new.select("path", F.sha2("text", 256).alias("b"))
    return a.join(b, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def is_fresh(header: DataFrame, head: str, changed: DataFrame) -> DataFrame:
    """One row: whether the ledger's commit is ``head`` and no file in its scopes has changed."""
    dirty = changed.join(F.broadcast(header.select("scopes")), (F.get("scopes", F.lit(0)) == "all") | F.exists("scopes", lambda s: F.col("path").startswith(s))).agg(F.count(F.lit(1)).alias("dirty"))
    return header.select("commit").join(dirty).select(((F.col("commit") == head) & (F.col("dirty") == 0)).alias("fresh"))


def subsume_dep(edges: DataFrame) -> DataFrame:
    """`dep` edges only where no other edge joins the pair; elsewhere they become its receipts."""
    dep = edges.filter("rel = 'dep'")
    other = edges.filter("rel <> 'dep'")
    pairs = other.select(F.least("actor", "object").alias("lo"), F.greatest("actor", "object").alias("hi")).distinct()
    ends = dep.withColumn("lo", F.least("actor", "object")).withColumn("hi", F.greatest("actor", "object"))
    alone = ends.join(pairs, ["lo", "hi"], "left_anti").select(*edges.columns)
    support = ends.join(pairs, ["lo", "hi"], "left_semi").groupBy("lo", "hi").agg(F.flatten(F.collect_list("receipts")).alias("more"))
    held = other.withColumn("lo", F.least("actor", "object")).withColumn("hi", F.greatest("actor", "object")).join(support, ["lo", "hi"], "left")
    held = held.withColumn("receipts", F.concat("receipts", F.coalesce("more", F.array().cast(RECEIPTS)))).select(*edges.columns)
    return held.unionByName(alone)


def label_cap(edges: DataFrame, most: int = 6) -> DataFrame:
    """Per (actor, rel, object): the first ``most`` labels and how many more there are."""
    labels = F.array_sort(F.collect_set("label"))
    grouped = edges.groupBy("actor", "rel", "object").agg(labels.alias("labels"))
    more = F.size("labels") - most
    return grouped.select("actor", "rel", "object", F.array_join(F.slice("labels", 1, most), ", ").alias("shown"), F.when(more > 0, F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))).otherwise("").alias("more"))
