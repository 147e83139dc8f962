"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

1. **Targets.**  Sources share ``share`` times all words by weight, capped at
   ``most`` times their own words, the excess going to the others by weight.
   With sources ordered by cap over weight this is one cumulative sum.
2. **Whole copies.**  Each document of a source is taken ``floor(target / size)``
   times for certain.
3. **Pareto order.**  The rest of the target is a sample of fixed size, in words.
   A document with inclusion probability p (proportional to the square root of
   its words) and a uniform number u from a hash of its doc_id is ranked by the
   random odds u / (1 - u) over the inclusion odds p / (1 - p); documents are
   taken in that order until the words are reached.

The order is not sorted in one task: documents are dealt to cells by rank, cells
have a word sum each, and only the cell in which the target is reached is sorted.
A cell holds about ``CELL`` documents, whatever the size of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Documents in a cell, about.
CELL = 2_000
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
_HALF = 1 << 52


def _uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from the key's digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(_HALF))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Target words of each source: ``source, source_size, target``.

    ``sizes`` has one row per source with its words.  Weights are dealt in code
    point order, null last.  One row per source meets in the windows, some 60 bytes
    each: sources are named sets of documents, up to some millions.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("turn", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    named = named.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), F.col("turn") + 1))
    named = named.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_ = F.sum("source_size").over(everything).cast("double") * F.lit(share[0]) / F.lit(share[1])
    left = named.withColumn("left_words", all_ - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    left = left.withColumn("left_weight", F.sum("weight").over(after))
    left = left.withColumn("capped", F.col("left_words") * F.col("weight") >= F.col("cap") * F.col("left_weight"))
    # the sources from the first that isn't capped on share what is left then
    first = F.max(F.when(~F.col("capped"), F.struct("left_weight", "left_words"))).over(everything)
    left = left.withColumn("first", first)
    return left.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("first.left_words") * F.col("weight") / F.col("first.left_weight")).alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, carry: tuple[str, ...] | None = None) -> DataFrame:
    """How often each document goes into the mix.

    Input: ``doc_id, text, source``.  The input row, or its columns ``carry`` only
    (texts then don't travel), comes back as the struct ``row`` beside ``size`` (words), ``source_size, target``, ``copies`` and
    ``taken`` (words, repeats counted).  ``copies`` never exceeds ``most``.

    A null or empty text has size 0 and no copies; a null source is a source of
    its own; rows that repeat a doc_id draw the same number and are ordered by
    size, so reruns agree; a source without words has target 0; an empty table
    gives no rows.
    """
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("bigint")
    d = docs.select(F.struct(*(docs[c] for c in carry or docs.columns)).alias("row"), "doc_id", "source", size.alias("size"))
    if carry is not None:  # narrow rows: every text is split once
        d = written(d)
    d = d.withColumn("pull", F.floor(F.sqrt(F.col("size").cast("double")) * 1000).cast("bigint"))
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("pull") * F.col("size")).cast("decimal(38,0)")).alias("pulled"), F.count(F.lit(1)).alias("n"))
    aims = targets(sums.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s")
    per = aims.join(sums.select(F.col("source"), "pulled", "n"), F.col("s").eqNullSafe(F.col("source"))).drop("source")
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("bigint"))
    per = per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # p = rest * pull / sum(pull * size): the expected words are the rest
    per = per.withColumn("scale", F.when(F.col("pulled") > 0, F.col("rest") / F.col("pulled").cast("double")).otherwise(F.lit(0.0)))
    per = per.withColumn("cells", F.ceil(F.col("n") / F.lit(CELL)).cast("bigint")).drop("n", "pulled")

    d = d.join(per, d["source"].eqNullSafe(per["s"])).drop("s")
    p = F.least(F.col("scale") * F.col("pull"), F.lit(1.0))
    u = _uniform(F.col("doc_id"), seed)
    d = d.withColumn("p", p).withColumn("u", u)
    rank = F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))).otherwise(F.lit(float("inf")))
    d = d.withColumn("rank", rank)
    # rank / (1 + rank) lies in [0, 1] and keeps the order
    d = d.withColumn("cell", F.least(F.when(F.col("rank") == float("inf"), F.col("cells") - 1).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("cells"))), F.col("cells") - 1).cast("bigint"))
    cells = d.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    reached = cells.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    reached = reached.groupBy("source").agg(F.min(F.struct("cell", "before")).alias("r")).select(F.col("source").alias("s"), F.col("r.cell").alias("at"), F.col("r.before").alias("before"))
    d = d.join(reached, d["source"].eqNullSafe(reached["s"]), "left").drop("s")
    edge = d.filter(F.col("cell") == F.col("at"))
    order = Window.partitionBy("source", "cell").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    # the document in which the target is reached counts if most of it fits
    edge = edge.withColumn("more", (so_far * 2 + F.col("size") <= F.col("rest") * 2).cast("bigint"))
    sure = d.filter(F.col("at").isNull() | (F.col("cell") != F.col("at")))
    sure = sure.withColumn("more", (F.coalesce(F.col("cell") < F.col("at"), F.col("rest") > 0) & (F.col("rest") > 0)).cast("bigint"))
    out = sure.unionByName(edge)
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("more"), F.lit(most))).otherwise(F.lit(0)).cast("bigint")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    out = mix(docs, **how).filter("copies > 0")
    return out.select(F.col("row"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, carry=("doc_id",)).select("row.doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
e AS (SELECT *, floor(sqrt(size::DOUBLE) * 1000)::BIGINT AS pull,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(pull::HUGEINT * size)::HUGEINT AS pulled FROM e GROUP BY source),
n AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
l AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE * 3 / 2 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_words,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM n WINDOW o AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source)),
f AS (SELECT left_words AS rest, left_weight AS rest_weight FROM l WHERE NOT left_words * weight >= cap::DOUBLE * left_weight::DOUBLE ORDER BY left_weight DESC LIMIT 1),
t AS (SELECT source, source_size, pulled, CASE WHEN left_words * weight >= cap::DOUBLE * left_weight::DOUBLE THEN cap::DOUBLE ELSE rest * weight / rest_weight::DOUBLE END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT e.doc_id, e.source, e.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest, e.u,
  least(CASE WHEN p.pulled > 0 THEN (p.target - p.whole * p.source_size) / p.pulled::DOUBLE ELSE 0 END * e.pull, 1.0) AS p
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) ELSE 'Infinity'::DOUBLE END AS rank FROM q),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN least(whole + CASE WHEN rest > 0 AND before * 2 + size <= rest * 2 THEN 1 ELSE 0 END, 2) * size ELSE 0 END::BIGINT AS taken FROM c
"""
