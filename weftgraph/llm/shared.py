"""Written intermediate tables and connected components, shared by the link operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where the setting is absent a local session (tests) gets a new local folder;
    on a cluster that is an error, as executors don't share local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def text_batches(df: DataFrame, most: int = 4 << 20) -> None:
    """Let the session hand rows to Python in Arrow batches of at most ``most`` bytes, or of one row.

    Spark reads the setting when the result is computed, so it holds for the session;
    a smaller one stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = df.sparkSession.conf.get(key, None)
    if found is None or not found.isdigit() or not 0 < int(found) <= most:
        df.sparkSession.conf.set(key, str(most))


#: Tasks of one exchange at most.  Groups are bounded by their own size and follow each other in a task;
#: a task for every group would make blocks that grow with the square of the input.
MOST_TASKS = 20_000


def tasks(groups: int) -> int:
    """Partitions for so many groups."""
    return max(1, min(groups, MOST_TASKS))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder, and read them back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Members of a key that meet in one block of block_pairs().
BLOCK = 512


def block_pairs(members: DataFrame) -> DataFrame:
    """All pairs ``x.id < y.id`` of the rows of each ``key``, as rows aliased x and y.

    A key with many members is cut into blocks by id, and every two blocks meet
    under a key of their own, so that no task gets a whole frequent key.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")
    x, y = m.alias("x"), m.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "lo", "hi")]
    return x.join(y, same[0] & same[1] & same[2] & (F.col("x.id") < F.col("y.id")) & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.block") != F.col("y.block"))))


def link_counts(links: DataFrame) -> DataFrame:
    """Number of links of every node that has one: ``(id, n_links)``."""
    return links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))


def led(members: DataFrame) -> DataFrame:
    """Members of keys under the leaders of their keys: distinct ``(g, id)``.

    ``members`` has ``key, id``.  A key's leader is the member with the most keys:
    of near copies that is the one in the middle, from which the others were made.
    Groups whose leaders are in turn members of another group are joined to that, two steps up.
    """
    keys = members.groupBy("id").agg(F.count(F.lit(1)).alias("keys"))
    # the order as one number, which a hash aggregate can keep the largest of
    order = F.call_function("shiftleft", F.col("keys"), F.lit(40)).bitwiseOR(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)))
    ranked = keys.select("id", order.alias("order"))
    first = members.join(ranked, "id").groupBy("key").agg(F.max("order").alias("order"))
    groups = written(members.join(first, "key").select("order", "id").distinct().join(ranked.withColumnRenamed("order", "own"), "id"))
    # a leader that is a member of another group takes its own there: any common one will do
    up = groups.groupBy("own").agg(F.max("order").alias("up"))
    for _ in range(2):
        groups = groups.join(up.withColumnRenamed("own", "order"), "order").select(F.col("up").alias("order"), "id", "own").distinct()
    leader = ranked.groupBy("order").agg(F.min("id").alias("g"))
    return groups.join(leader, "order").select("g", "id").distinct()


def beyond_leaders(rest: DataFrame, sets: DataFrame, reach: Callable[[Column, Column], Column], few: bool = False) -> DataFrame:
    """Pairs of one leader's group, in different components, whose sets may be close: ``(a, b)``, ``a < b``.

    ``rest`` has ``g, id, component`` and ``sets`` ``id, elements`` (distinct), also
    of the leaders.  ``reach(n, m)``, which grows with m, bounds the elements in
    which linked sets of n and m elements differ.

    x and y differ in exactly the elements in which their differences to the leader
    differ.  Members that aren't linked with the leader have large differences, so
    those of a linked pair share many elements, and two sets that share many share
    one of the first few in a common order (prefix filter): here the rarest of the
    group first, as many as the sizes of the two differences leave possible.
    Before that a member goes that can be linked with none: in a plain common order, more of
    the first elements of its difference than linked sets may differ in are among no other
    member's first ones (of linked members' differences, cut to one length, each has at most
    that many that the other lacks).
    Elements of one member only count in that order, but aren't joined; those of most
    members are kept as an array of the group, so that a leader unlike its members doesn't
    make a row of each of its elements for each of them.  Near copies that were changed in
    different places share no rare element and don't meet, however many there are.

    Where the bound is a small number (``few``), nothing is counted: elements that the
    leader lacks come before those that only it has, and only the first few of a
    difference leave its row.  Two differences may then have nothing in common, if
    they are small together; those meet by their sizes, at least one of them
    outside the leader's component.
    """
    both = rest.join(sets, "id").join(sets.select(F.col("id").alias("g"), F.col("elements").alias("theirs")), "g")
    own = F.concat(F.array_sort(F.array_except("elements", "theirs")), F.array_sort(F.array_except("theirs", "elements")))
    both = written(both.select("g", "id", "component", F.size("elements").alias("n"), F.size(own).alias("s"), own.alias("own")))
    sized = lambda rows: rows.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("largest"), F.avg("n").cast("bigint").alias("mean"), F.max(F.when(F.col("id") == F.col("g"), F.col("component"))).alias("home"))
    groups, most = sized(both), reach(F.col("n"), F.col("largest")).cast("int")
    if few:
        d = both.join(groups, "g").withColumn("most", most)
        at = d.select("g", "id", "component", "n", "s", "most", "own", F.posexplode(F.slice("own", 1, F.col("most") + 1)).alias("pos", "e")).withColumn("pos", F.col("pos") + 1)
        # of two members the one with the smaller difference has half as many to show
        bands, key = at.filter(F.col("pos") <= F.floor(F.col("most") / 2) + 1), F.xxhash64("g", "e")
    else:
        # one number of first elements for the whole group: of two linked members' first ones each has all but ``most`` among the other's
        at_once = (2 * reach(F.col("mean"), F.col("mean")) + 1).cast("int")
        d = both.join(groups, "g").select("g", "id", "component", "n", "s", "own", most.alias("most"), F.slice("own", 1, at_once).alias("first"))
        each = d.select("g", "id", F.explode("first").alias("e"))
        again = each.groupBy("g", "e").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").drop("often")
        met = each.join(again, ["g", "e"]).groupBy("g", "id").agg(F.count(F.lit(1)).alias("met"))
        d = d.join(met, ["g", "id"], "left").filter(F.size("first") - F.coalesce("met", F.lit(0)) <= F.col("most"))
        both = written(d.drop("most", "first", "met"))
        groups = sized(both)
        step = F.greatest(F.lit(1), F.floor(reach(F.col("largest"), F.col("largest")) / 16)).cast("int")
        each = both.join(groups.select("g", "members"), "g").select("g", "members", F.explode("own").alias("e"))
        often = written(each.groupBy("g", "members", "e").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
        # elements in which most of the group differ, such as those that only the leader has, come last in the order: they follow as arrays
        usual = often.filter("2 * often > members").groupBy("g").agg(F.collect_list("e").alias("usual"))
        groups = groups.join(usual, "g", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
        d = both.join(groups, "g").withColumn("tail", F.array_sort(F.array_intersect("own", "usual"))).withColumn("own", F.array_except("own", "usual"))
        d = written(d.select("g", "id", "component", "n", "s", "own", "tail", most.alias("most"), step.alias("step")).withColumn("band", F.floor(F.col("s") / F.col("step")).cast("int")))
        ordered = d.select("g", "id", F.explode("own").alias("e")).join(often.drop("members"), ["g", "e"]).groupBy("g", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "e"))), lambda x: x["e"]).alias("shared"))
        d = d.drop("own").join(ordered, ["g", "id"], "left").withColumn("shared", F.concat(F.coalesce("shared", F.array().cast("array<bigint>")), "tail"))
        d = written(d.drop("tail").filter(F.size("shared") > 0))
        at = d.select("g", "id", "component", "n", "s", "most", "step", "band", F.size("shared").alias("k"), F.posexplode("shared").alias("pos", "e"))
        at = at.withColumn("pos", F.col("s") - F.col("k") + F.col("pos") + 1).filter(F.col("pos") <= F.col("most") + 1)
        # of two members the one with the smaller difference looks for the bands of the other's
        bands = at.withColumn("band", F.explode(F.sequence("band", F.floor((F.col("s") + F.col("most")) / F.col("step")).cast("int"))))
        shared = F.greatest(F.lit(1), F.ceil((F.col("s") + F.greatest(F.col("s"), F.col("band") * F.col("step")) - F.col("most")) / 2))
        bands, key = bands.filter(F.col("pos") <= F.col("s") - shared + 1), F.xxhash64("g", "e", "band")
    kept = ("id", "component", "n", "s", "pos", *(["own"] if few else []))
    x, y = bands.select(key.alias("key"), *kept).alias("x"), at.select(key.alias("key"), *kept).alias("y")
    shared = F.greatest(F.lit(1), F.ceil((F.col("x.s") + F.col("y.s") - reach(F.col("x.n"), F.col("y.n"))) / 2))
    possible = (F.col("x.s") - F.col("x.pos") + 1 >= shared) & (F.col("y.s") - F.col("y.pos") + 1 >= shared)
    order = (F.col("x.s") < F.col("y.s")) | ((F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")))
    if few:  # small enough to be compared at once
        possible &= F.col("x.s") + F.col("y.s") - 2 * F.size(F.array_intersect("x.own", "y.own")) <= reach(F.col("x.n"), F.col("y.n"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & order & possible)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    if few:
        small = d.filter("s <= most")
        x, y = small.filter("home is null or component <> home").alias("x"), small.alias("y")
        near = F.col("x.s") + F.col("y.s") <= reach(F.col("x.n"), F.col("y.n"))
        small = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.component") != F.col("y.component")) & near)
        pairs = pairs.unionAll(small.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    return pairs.distinct()


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has an edge: ``(id, component)``.

    ``edges`` has bigint columns ``a`` and ``b``; direction, repetition and self
    loops don't matter.  Alternates the large-star and small-star contractions,
    each a ``min`` per node (partial aggregation) and a join back that adaptive
    execution can split, until the edges no longer change: O(log^2 n) rounds.
    Each round is written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    e = written(e)
    before = _print(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours of a node move to the least of its neighbourhood
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        e = written(e)
        # small star: smaller neighbours of a node, and itself, move to the least of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a > b").distinct()
        e = written(e)
        after = _print(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
