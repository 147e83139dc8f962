"""Questions to lenses: the explicit form, subject resolution, and custom lenses.

``ask`` takes a ledger and a question such as ``impact basket`` or ``path a b``
and returns the lens' edges or rows.  New lenses are registered callables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, review
from ..schema import AmbiguousSubject

#: Lenses with their number of subjects.
SUBJECTS = {"overview": 0, "focus": 1, "lineage": 1, "path": 2, "impact": 1, "deps": 1, "data": 0, "diff": 0, "review": 0}
#: Words of a free question that point to a lens, first match wins.
HINTS = (("break", "impact"), ("affect", "impact"), ("depend", "deps"), ("need", "deps"), ("flow", "lineage"), ("event", "lineage"), ("how does", "path"), ("reach", "path"), ("database", "data"), ("store", "data"), ("chang", "diff"), ("smell", "review"), ("review", "review"), ("around", "focus"), ("overview", "overview"))

_custom: dict[str, Callable[..., DataFrame]] = {}


@dataclass(frozen=True)
class Question:
    lens: str
    subjects: tuple[str, ...]


def parse(question: str) -> Question:
    """The lens and the subjects of a question; free text is routed by keyword and keeps its quoted names."""
    words = question.split()
    if words and (words[0] in SUBJECTS or words[0] in _custom):
        n = SUBJECTS.get(words[0])
        if n is not None and len(words) - 1 < n:
            raise AmbiguousSubject(f"{words[0]} takes {n} subjects")
        return Question(words[0], tuple(words[1:] if n is None else words[1 : n + 1]))
    lower = question.lower()
    lens = next((name for hint, name in HINTS if hint in lower), "overview")
    quoted = tuple(question.split("`")[1::2])
    return Question(lens, quoted[: SUBJECTS[lens]])


def register(name: str, lens: Callable[..., DataFrame]) -> None:
    """Add a lens: a function of (nodes, edges, *subjects)."""
    _custom[name] = lens


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """The one node that a name means, as ``id``: exact, else the only id that contains it."""
    found = nodes.filter(F.lower("id").contains(name.lower())).select("id", (F.col("id") == name).alias("exact"))
    rows = found.orderBy(F.desc("exact"), "id").limit(2).collect()
    if not rows or (len(rows) > 1 and not rows[0]["exact"]):
        raise AmbiguousSubject(f"{name}: {[r['id'] for r in rows]}")
    return nodes.filter(F.col("id") == rows[0]["id"]).select("id")


def ask(nodes: DataFrame, edges: DataFrame, question: str, old: DataFrame | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Answer a question; ``old`` is the earlier ledger of a diff, ``kinds`` narrow the view to edges at such nodes."""
    q = parse(question)
    start = [resolve(nodes, s) for s in q.subjects]
    if q.lens in _custom:
        out = _custom[q.lens](nodes, edges, *start)
    elif q.lens == "diff":
        if old is None:
            raise ValueError("diff needs an earlier ledger")
        return graph.diff(old, edges)
    elif q.lens == "review":
        return review.ordered(review.findings(nodes, edges))
    elif q.lens == "path":
        return graph.simple_paths(edges, start[0], start[1])
    elif q.lens in ("impact", "deps"):
        return getattr(graph, q.lens)(edges, start[0])
    elif q.lens == "data":
        return graph.data(nodes, edges)
    else:
        out = {"overview": lambda: graph.overview(edges), "focus": lambda: graph.focus(edges, start[0]), "lineage": lambda: graph.lineage(edges, start[0])}[q.lens]()
    return graph.stores_only(nodes, out, kinds).edges if kinds else out


def where(predicate: Column) -> Callable[..., DataFrame]:
    """A custom lens that keeps the edges for which a condition holds."""
    return lambda nodes, edges, *_: edges.filter(predicate)


def wording(edges: DataFrame) -> DataFrame:
    """One sentence per edge; an inferred edge is never stated as fact."""
    fact = F.concat_ws(" ", "actor", "rel", "object")
    guess = F.concat(F.col("actor"), F.lit(" appears to "), F.col("rel"), F.lit(" "), F.col("object"), F.lit(" (unconfirmed: "), F.coalesce("note", F.lit("no note")), F.lit(")"))
    return edges.withColumn("sentence", F.when(F.col("tag") == "CODE", fact).otherwise(guess))


def shard_footers(edges: DataFrame, gaps: DataFrame, hits: DataFrame) -> DataFrame:
    """Totals per ``shard`` of distributed extraction: hits, code edges, inferred edges, gaps."""
    e = edges.groupBy("shard").agg(F.count_if(F.col("tag") == "CODE").alias("code"), F.count_if(F.col("tag") != "CODE").alias("inferred"))
    g = gaps.groupBy("shard").agg(F.count(F.lit(1)).alias("gaps"))
    h = hits.groupBy("shard").agg(F.count(F.lit(1)).alias("hits"))
    return h.join(e, "shard", "full_outer").join(g, "shard", "full_outer").na.fill(0)


def worth_sharding(services: DataFrame, hits: DataFrame, most_services: int = 25, most_hits: int = 400) -> DataFrame:
    """One row: whether a repository is large enough to be swept in shards."""
    s = services.agg(F.count(F.lit(1)).alias("services"))
    h = hits.agg(F.count(F.lit(1)).alias("hits"))
    return s.join(h).select("services", "hits", ((F.col("services") > most_services) | (F.col("hits") > most_hits)).alias("shard"))
