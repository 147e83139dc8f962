"""Views as text: Mermaid, sequence diagrams, Markdown tables and draw.io cells.

Rows become strings with column expressions and ordered aggregation; a view is
small by definition (clusters beyond 30 nodes), so it ends in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST_NODES = 30
#: Shapes of Mermaid nodes by kind, around the quoted label.
SHAPES = {"svc": ('["', '"]'), "ref": ('["', ' ?"]'), "topic": ('{{"', '"}}'), "queue": ('[/"', '"/]'), "db": ('[("', '")]'), "store": ('[("', '")]'), "cache": ('[("', '")]'), "ext": ('(["', '"])')}
#: Width and height of draw.io cells.
SIZES = {"svc": (160, 60), "ref": (160, 60), "topic": (140, 60), "queue": (140, 60), "ext": (140, 60), "db": (120, 80), "store": (120, 80), "cache": (120, 80)}


#: Stroke of draw.io edges by relation.
STROKES = {"pub": "#8250df", "sub": "#8250df", "http": "#0969da", "grpc": "#0969da", "gql": "#0969da", "ws": "#0969da", "uses": "#1a7f37"}


#: Colours of the classes that a diagram declares.
CLASSES = {"svc": "fill:#ddf4ff,stroke:#0969da", "ref": "fill:#f6f8fa,stroke:#57606a", "topic": "fill:#fbefff,stroke:#8250df", "db": "fill:#dafbe1,stroke:#1a7f37", "cache": "fill:#fff8c5,stroke:#9a6700", "ext": "fill:#f6f8fa,stroke:#57606a", "focus": "fill:#0969da,color:#fff", "hit1": "fill:#ffebe9,stroke:#cf222e", "hit2": "fill:#fff8c5,stroke:#9a6700", "warn": "fill:#fff1e5,stroke:#bc4c00", "add": "fill:#dafbe1,stroke:#1a7f37", "prop": "fill:#fbefff,stroke:#8250df"}


def _by_kind(kind: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def mermaid_ids(nodes: DataFrame) -> DataFrame:
    """Nodes with a unique diagram id ``mid``: ids that fall together get a number, by byte order of the node id."""
    d = nodes.withColumn("plain", T.mermaid_id(F.col("kind"), F.col("id")))
    n = F.row_number().over(Window.partitionBy("plain").orderBy("id"))
    return d.withColumn("n", n).withColumn("mid", F.when(F.col("n") == 1, F.col("plain")).otherwise(F.concat("plain", F.lit("_"), F.col("n").cast("string")))).drop("plain", "n")


def mermaid_class(kind: Column) -> Column:
    return F.when(kind == "queue", "topic").when(kind == "store", "db").otherwise(kind)


def node_lines(nodes: DataFrame) -> DataFrame:
    ids = mermaid_ids(nodes)
    opened, closed = _by_kind(F.col("kind"), {k: v[0] for k, v in SHAPES.items()}, '["'), _by_kind(F.col("kind"), {k: v[1] for k, v in SHAPES.items()}, '"]')
    return ids.select("id", "kind", "mid", F.concat(F.lit("  "), "mid", opened, F.replace("id", F.lit('"'), F.lit("'")), closed).alias("line"))


def edge_lines(nodes: DataFrame, edges: DataFrame, numbered: bool = False) -> DataFrame:
    """One Mermaid line per edge, in data-flow direction; ``state`` (added, removed) is optional."""
    from ..operators.graph import flow

    ids = mermaid_ids(nodes).select("id", "mid")
    d = flow(edges).join(ids.withColumnRenamed("id", "src").withColumnRenamed("mid", "a"), "src").join(ids.withColumnRenamed("id", "dst").withColumnRenamed("mid", "b"), "dst")
    state = F.col("state") if "state" in edges.columns else F.lit("")
    arrow = F.when(state == "added", "==>").when(state == "removed", "-.-x").when(F.col("tag") == "CODE", "-->").otherwise("-.->")
    label = T.elide(F.concat_ws(" ", "rel", F.when(F.col("label") != "-", F.col("label"))))
    if numbered:
        label = F.concat(F.col("step").cast("string"), F.lit(". "), label)
    return d.withColumn("line", F.concat(F.lit("  "), "a", F.lit(" "), arrow, F.lit('|"'), F.replace(label, F.lit('"'), F.lit("'")), F.lit('"| '), "b"))


def flowchart(nodes: DataFrame, edges: DataFrame, direction: str = "LR", marks: DataFrame | None = None) -> DataFrame:
    """One row ``mermaid``.  ``marks`` (``id, class``) override the class by kind."""
    n = node_lines(nodes)
    kinds = n.select("id", "mid", mermaid_class(F.col("kind")).alias("class"))
    if marks is not None:
        kinds = kinds.join(marks.select("id", F.col("class").alias("mark")), "id", "left").select("id", "mid", F.coalesce("mark", "class").alias("class"))
    per = kinds.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("mid")), ",").alias("ids"))
    colour = _by_kind(F.col("class"), CLASSES, "")
    declared = per.filter(F.col("class").isin(*CLASSES)).select(F.concat(F.lit("  classDef "), "class", F.lit(" "), colour).alias("line"))
    classes = per.select(F.concat(F.lit("  class "), "ids", F.lit(" "), "class").alias("line"))
    parts = n.select(F.lit(1).alias("part"), "line").unionByName(edge_lines(nodes, edges).select(F.lit(2).alias("part"), "line")).unionByName(classes.select(F.lit(3).alias("part"), "line")).unionByName(declared.select(F.lit(4).alias("part"), "line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")
    return parts.agg(F.concat(F.lit(f"flowchart {direction}\n"), body).alias("mermaid"))


def sequence(steps: DataFrame) -> DataFrame:
    """One row ``mermaid`` of a path: ``step, src, dst, label, tag`` and, where messages have another arrow, ``rel``."""
    people = steps.select(F.col("src").alias("id"), (F.col("step") * 2).alias("at")).unionByName(steps.select(F.col("dst").alias("id"), (F.col("step") * 2 + 1).alias("at")))
    names = people.groupBy("id").agg(F.min("at").alias("at")).select(F.lit(0).alias("part"), "at", F.concat(F.lit("  participant "), F.regexp_replace("id", "[^A-Za-z0-9]", "_"), F.lit(" as "), "id").alias("line"))
    short = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    arrow = F.when(F.col("rel").isin("pub", "sub"), "-)").when(F.col("tag") == "CODE", "->>").otherwise("-->>") if "rel" in steps.columns else F.when(F.col("tag") == "CODE", "->>").otherwise("-->>")
    calls = steps.select(F.lit(1).alias("part"), F.col("step").alias("at"), F.concat(F.lit("  "), short("src"), arrow, short("dst"), F.lit(": "), "label").alias("line"))
    all_ = names.unionByName(calls)
    return all_.agg(F.concat(F.lit("sequenceDiagram\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n")).alias("mermaid"))


def receipts_table(edges: DataFrame) -> DataFrame:
    """One row ``table``: the drawn edges and their receipts."""
    line = F.concat(F.lit("| "), T.caption(F.col("actor"), F.col("object"), F.col("label"), F.col("tag")), F.lit(" | "), F.col("tag"), F.lit(" | "), T.receipt_cell(F.col("receipts")), F.lit(" |"))
    body = edges.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("b"))
    return body.select(F.concat(F.lit("| Edge | Evidence | Receipts |\n|---|---|---|\n"), "b").alias("table"))


def stats_line(edges: DataFrame) -> DataFrame:
    """One row ``line``; the inferred part is left out when there is none."""
    from ..operators.graph import stats

    return stats(edges).select(F.concat(F.format_string("%d nodes · %d edges (%d CODE", "nodes", "edges", "code"), F.when(F.col("inferred") > 0, F.format_string(" / %d inferred", "inferred")).otherwise(""), F.lit(")")).alias("line"))


def not_shown(nodes: DataFrame, view_edges: DataFrame, edges: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps about the view's nodes, and ledger edges at them that the view hides: ``what, detail``."""
    from ..schema import EDGE_KEY

    ids = nodes.select("id")
    about = gaps.join(ids, F.col("subject") == F.col("id"), "left_semi").select(F.lit("gap").alias("what"), F.concat_ws(": ", "subject", "detail").alias("detail"))
    hidden = edges.join(view_edges.select(*EDGE_KEY), EDGE_KEY, "left_anti").join(ids, (F.col("actor") == F.col("id")) | (F.col("object") == F.col("id")), "left_semi")
    return about.unionByName(hidden.select(F.lit("hidden").alias("what"), T.caption(F.col("actor"), F.col("object"), F.col("label"), F.col("tag")).alias("detail")))


def markdown(title: str, nodes: DataFrame, edges: DataFrame, direction: str = "LR", answer: str = "", commit: str = "", gaps: DataFrame | None = None, ledger: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """One row ``view``: title, totals with the ledger's commit, answer, diagram, receipts, and what is not shown.

    ``gaps`` and the whole ``ledger`` of edges give the last part; ``title`` names lens and subject.
    """
    row = stats_line(edges).join(flowchart(nodes, edges, direction, marks)).join(receipts_table(edges))
    hidden = F.lit("")
    if gaps is not None and ledger is not None:
        said = not_shown(nodes, edges, ledger, gaps)
        row = row.join(said.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "what", F.lit(": "), "detail"))), "\n").alias("hidden")))
        hidden = F.when(F.col("hidden") != "", F.concat(F.lit("\nNot shown:\n\n"), "hidden", F.lit("\n"))).otherwise("")
    head = F.concat(F.lit(f"# {title}\n\n"), "line", F.lit(f" · ledger {commit}" if commit else ""), F.lit(f"\n\n{answer}" if answer else ""))
    return row.select(F.concat(head, F.lit("\n\n```mermaid\n"), "mermaid", F.lit("\n```\n\n"), "table", F.lit("\n"), hidden).alias("view"))


def ring_table(reasons: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``table`` of an impact: ring, service, why it breaks, and the primary receipts of its edges."""
    first = edges.select(F.col("actor").alias("node"), F.get("receipts", F.lit(0)).alias("r")).filter("r is not null")
    cited = first.groupBy("node").agg(F.array_sort(F.collect_set(F.concat(F.col("r.path"), F.lit(":"), F.get("r.lines", F.lit(0)).cast("string")))).alias("cited"))
    d = reasons.join(cited, "node", "left")
    line = F.concat(F.lit("| "), F.col("ring").cast("string"), F.lit(" | "), "node", F.lit(" | "), "reasons", F.lit(" | "), F.array_join(F.transform(F.coalesce("cited", F.array().cast("array<string>")), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), " · "), F.lit(" |"))
    body = d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ring", "node", line.alias("line")))), lambda x: x["line"]), "\n").alias("b"))
    return body.select(F.concat(F.lit("| Ring | Service | Breaks because | Receipts |\n|---|---|---|---|\n"), "b").alias("table"))


def path_steps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges along paths (``nodes``) with their ``step`` from 1: what edge_lines numbers and sequence draws."""
    from ..operators.graph import flow

    hops = paths.select(F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("src"), F.slice("nodes", 2, F.size("nodes") - 1).alias("dst"))).alias("at", "hop"))
    hops = hops.select((F.col("at") + 1).alias("step"), "hop.src", "hop.dst").distinct()
    return flow(edges).join(hops, ["src", "dst"]).select("step", *edges.columns, "src", "dst")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer and row of each node for drawing: ``id, rank, row``.

    Message, use and dependency edges rank, then in ledger order each call whose
    target doesn't already reach its source.  A node without predecessors has rank
    0, others 1 + the largest of their predecessors; within a rank nodes stand by
    the mean row of their predecessors, then by id.  The order of the edges
    matters, so they are folded in one row: a view that is drawn has at most
    ``MOST_NODES`` nodes.
    """
    from ..operators.graph import flow
    from ..schema import SYNC

    d = flow(edges).filter("src <> dst").select(F.struct(F.col("rel").isin(*SYNC).alias("call"), "actor", "rel", "object", "label", "src", "dst").alias("e"))
    row = nodes.agg(F.array_sort(F.collect_set("id")).alias("ids")).join(d.agg(F.array_sort(F.collect_set("e")).alias("es")))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    none = F.array().cast("array<struct<a:string,b:string>>")

    def add(s: Column, e: Column) -> Column:
        from_ = F.concat(F.array(e["src"]), F.transform(F.filter(s["reach"], lambda r: r["b"] == e["src"]), lambda r: r["a"]))
        to = F.concat(F.array(e["dst"]), F.transform(F.filter(s["reach"], lambda r: r["a"] == e["dst"]), lambda r: r["b"]))
        more = F.array_union(s["reach"], F.flatten(F.transform(from_, lambda x: F.transform(to, lambda y: pair(x, y)))))
        back = F.array_contains(s["reach"], pair(e["dst"], e["src"]))
        return F.struct(F.when(back, s["reach"]).otherwise(more).alias("reach"), F.when(back, s["kept"]).otherwise(F.array_union(s["kept"], F.array(pair(e["src"], e["dst"])))).alias("kept"))

    row = row.select("ids", F.aggregate("es", F.struct(none.alias("reach"), none.alias("kept")), add, lambda s: s["kept"]).alias("kept"))
    before = lambda id_: F.transform(F.filter("kept", lambda k: k["b"] == id_), lambda k: F.array_position("ids", k["a"]).cast("int"))
    higher = lambda ranks: F.transform("ids", lambda id_: F.coalesce(F.array_max(F.transform(before(id_), lambda p: F.get(ranks, p - 1) + 1)), F.lit(0)))
    row = row.withColumn("ranks", F.aggregate("ids", F.transform("ids", lambda _: F.lit(0)), lambda ranks, _: higher(ranks)))

    def place(rows: Column, rank: Column) -> Column:
        def mean(id_: Column) -> Column:
            at = F.transform(before(id_), lambda p: F.get(rows, p - 1))
            return F.when(F.size(at) == 0, F.lit(0.0)).otherwise(F.aggregate(at, F.lit(0.0), lambda n, x: n + x) / F.size(at))

        here = F.filter("ids", lambda id_, i: F.get("ranks", i) == rank)
        ordered = F.transform(F.array_sort(F.transform(here, lambda id_: F.struct(mean(id_).alias("m"), id_.alias("id")))), lambda x: x["id"])
        return F.transform("ids", lambda id_, i: F.when(F.get("ranks", i) == rank, F.array_position(ordered, id_).cast("int") - 1).otherwise(F.get(rows, i)))

    steps = F.sequence(F.lit(0), F.coalesce(F.array_max("ranks"), F.lit(0)))
    row = row.withColumn("rows", F.aggregate(steps, F.transform("ids", lambda _: F.lit(0)), place))
    return row.select(F.explode(F.arrays_zip("ids", "ranks", "rows")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.ranks").alias("rank"), F.col("x.rows").alias("row"))


def geometry(nodes: DataFrame) -> DataFrame:
    """Cells of nodes with ``rank`` and ``row``: ``x, y, width, height``."""
    w, h = (_by_kind(F.col("kind"), {k: v[i] for k, v in SIZES.items()}, SIZES["svc"][i]) for i in (0, 1))
    return nodes.withColumn("width", w).withColumn("height", h).withColumn("x", (40 + F.col("rank") * 240 + (160 - F.col("width")) / 2).cast("int")).withColumn("y", 40 + F.col("row") * 140)


def drawio(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``xml, note``.  Cells are numbered in ledger order.

    A view of more than ``MOST_NODES`` nodes is not drawn: ``xml`` is null and the note says so.
    """
    from ..operators.graph import flow

    drawn = nodes.limit(MOST_NODES + 1).count()
    if drawn > MOST_NODES:
        return nodes.agg(F.lit(None).cast("string").alias("xml"), F.format_string(f"%d nodes, more than {MOST_NODES}: not drawn, see the Mermaid view", F.count(F.lit(1))).alias("note"))
    placed = geometry(nodes.join(layers(nodes, edges), "id"))
    numbered = placed.withColumn("cell", F.concat(F.lit("n"), F.row_number().over(Window.orderBy("id")).cast("string")))
    style = _by_kind(F.col("kind"), {"topic": "shape=hexagon;", "queue": "shape=parallelogram;", "db": "shape=cylinder3;", "store": "shape=cylinder3;", "cache": "shape=cylinder3;", "ext": "rounded=1;arcSize=50;"}, "rounded=1;")
    vertex = numbered.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.format_string('<UserObject id="%s" label="%s" tooltip="%s"><mxCell style="%s" vertex="1" parent="1"><mxGeometry x="%d" y="%d" width="%d" height="%d" as="geometry"/></mxCell></UserObject>', "cell", T.xml_escape(F.col("id")), T.xml_escape(T.receipt_text(F.slice("receipts", 1, 1))), style, "x", "y", "width", "height").alias("xml"))
    ids = numbered.select("id", "cell")
    d = flow(edges).join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst")
    d = d.withColumn("cell", F.concat(F.lit("e"), F.row_number().over(Window.orderBy("actor", "rel", "object", "label")).cast("string")))
    dashed = F.when(F.col("tag") == "CODE", "").otherwise("dashed=1;")
    label = T.xml_escape(T.elide(F.concat_ws(" ", "rel", F.when(F.col("label") != "-", F.col("label")))))
    arc = d.select(F.lit(1).alias("part"), F.concat_ws(" ", "actor", "rel", "object", "label").alias("key"), F.format_string('<UserObject id="%s" label="%s" tooltip="%s"><mxCell style="endArrow=block;strokeColor=%s;%s" edge="1" parent="1" source="%s" target="%s"><mxGeometry relative="1" as="geometry"/></mxCell></UserObject>', "cell", label, T.xml_escape(T.receipt_text(F.slice("receipts", 1, 1))), _by_kind(F.col("rel"), STROKES, "#57606a"), dashed, "a", "b").alias("xml"))
    body = vertex.unionByName(arc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "xml"))), lambda x: x["xml"]), "").alias("b"))
    return body.select(F.concat(F.lit('<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>'), "b", F.lit("</root></mxGraphModel></diagram></mxfile>")).alias("xml"), F.lit(None).cast("string").alias("note"))


def overview(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """One row ``mermaid``: all edges but ``dep``; beyond ``MOST_NODES`` nodes one subgraph per cluster.

    External services of a cluster are then one node, ``3 external APIs``, and edges of the same ends one edge.
    """
    from ..operators.graph import clusters, flow
    from ..operators.graph import overview as lens

    shown = lens(edges)
    if nodes.limit(MOST_NODES + 1).count() <= MOST_NODES:
        return flowchart(nodes, shown, direction)
    owner = flow(shown).select(F.col("actor").alias("service"), F.col("object").alias("id")).groupBy("id").agg(F.min("service").alias("service"))
    c = clusters(nodes, "id")
    # an external node stands in the cluster of the first service that calls it
    home = c.filter("kind <> 'ext'").select(F.col("id").alias("service"), F.col("cluster").alias("home"))
    c = c.join(owner, "id", "left").join(home, "service", "left")
    c = c.withColumn("cluster", F.when(F.col("kind") == "ext", F.coalesce("home", "cluster")).otherwise(F.col("cluster")))
    count = F.count(F.lit(1)).over(Window.partitionBy("cluster", "kind"))
    c = c.withColumn("shown", F.when(F.col("kind") == "ext", F.concat(F.col("cluster"), F.lit(": "), count.cast("string"), F.lit(" external APIs"))).otherwise(F.col("id")))
    drawn = c.groupBy(F.col("shown").alias("id")).agg(F.min("kind").alias("kind"), F.min("cluster").alias("cluster"))
    to = c.select("id", "shown")
    e = shown.join(to.toDF("actor", "a"), "actor").join(to.toDF("object", "o"), "object").groupBy(F.col("a").alias("actor"), "rel", F.col("o").alias("object")).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.min("tag").alias("tag"))
    e = e.select("actor", "rel", "object", F.when(F.col("n") == 1, F.col("first")).otherwise(F.concat(F.lit("x"), F.col("n").cast("string"))).alias("label"), "tag")
    ids = node_lines(drawn).join(drawn.select("id", "cluster"), "id")
    sub = ids.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), "line"))), "\n").alias("inner"))
    sub = sub.select(F.lit(1).alias("part"), F.concat(F.lit("  subgraph "), F.regexp_replace("cluster", "[^A-Za-z0-9]", "_"), F.lit('["'), "cluster", F.lit('"]\n'), "inner", F.lit("\n  end")).alias("line"))
    parts = sub.unionByName(edge_lines(drawn, e).select(F.lit(2).alias("part"), "line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")
    return parts.agg(F.concat(F.lit(f"flowchart {direction}\n"), body).alias("mermaid"))


def review_view(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row ``view``: the health line, the table of findings, and the diagram with the nodes of high and medium findings marked."""
    from ..operators.review import health, health_line, severity_rank, warned

    keys = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("`"), e["actor"], F.lit(" "), e["rel"], F.lit(" "), e["object"], F.lit("`"))), " · ")
    line = F.concat(F.lit("| "), "id", F.lit(" | "), "severity", F.lit(" | "), F.replace("finding", F.lit("|"), F.lit("/")), F.lit(" | "), keys, F.lit(" |"))
    rows = found.select(F.struct(severity_rank(F.col("severity")).alias("r"), F.expr("cast(substring(id, 2) as int)").alias("n"), line.alias("line")).alias("x"))
    table = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("table"))
    chart = flowchart(nodes, edges, marks=warned(found).select("id", F.lit("warn").alias("class")))
    row = health_line(health(nodes, edges, found)).join(table).join(chart)
    return row.select(F.concat("line", F.lit("\n\n| Id | Severity | Finding | Evidence |\n|---|---|---|---|\n"), "table", F.lit("\n\n```mermaid\n"), "mermaid", F.lit("\n```\n")).alias("view"))
