"""Line dedup: segment-partition edit join with DataFrame operations only.

Distinct lines within a few edits of each other are linked.  A line of n
characters tolerates k(n) edits (0 below 20 characters, 1 below 40, else 2).

* **Index.**  A line is split into k + 1 even segments; k edits leave one of them
  whole (pigeonhole), so a near line has it as a substring, about where it was.
* **Probe.**  A line probes the lengths that may be linked with it, each segment
  number, and the start positions that the multi-match-aware bound allows: twelve
  substrings for k = 2, its own segments among them.  Index and probes meet on a
  hash of (length, segment number, substring) in one aggregation per key.
* **Verification.**  Banded bit-parallel edit distance: vertical differences of a
  band of 2k + 1 cells are kept in the bits of two integers, one step a character.
* **Groups.**  Equal lines are one class from the start.  Keys with few lines give
  all their pairs; the lines of others are compared with one leader, the line with
  the most such keys.  What is still in different components meets by the rarest
  triples of characters in which it differs from the leader (``beyond_leaders`` in
  shared.py).  The links that components don't need are found block by block when
  the table of links is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import beyond_leaders, block_pairs, connected_components, led, written

#: Characters from which one and two edits are tolerated.
EDITS_FROM = (20, 40)
#: Keys with more lines go under a leader instead of giving all pairs.
PAIRED = 8
#: Shared keys that are broadcast, at most (16 bytes each in memory); more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_BLANKS = " \\t\\x0b\\f\\r"


def tolerated(n: Column) -> Column:
    """Edits that a line of n characters tolerates."""
    return F.when(n >= EDITS_FROM[1], F.lit(2)).when(n >= EDITS_FROM[0], F.lit(1)).otherwise(F.lit(0))


def _structs(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, r, strict=True))) for r in rows))


def _lengths(n: Column) -> Column:
    """The tolerance ``k`` of each length that a line of n characters may be linked with, its own or ``more`` less."""
    one, two = EDITS_FROM

    def of(length: int) -> Column:
        found = [(2 if length - more >= two else 1 if length - more >= one else 0, more) for more in range(3)]
        return _structs([x for x in found if x[0] and x[1] <= x[0]], ("k", "more"))

    out = F.when(n >= two + 2, of(two + 2))
    for length in (two + 1, two):
        out = out.when(n == length, of(length))
    return out.when(n > one, of(one + 1)).otherwise(of(one))


def _places(k: Column, more: Column) -> Column:
    """Segments and shifts of the substrings that a line compares with lines of ``more`` characters less, ``own`` for its own."""

    def of(k: int, more: int) -> Column:
        shifts = lambda i: range(max(-(i - 1), more - (k + 1 - i)), min(i - 1, more + (k + 1 - i)) + 1)
        return _structs([(i, shift, int(more == shift == 0)) for i in range(1, k + 2) for shift in shifts(i)], ("i", "shift", "own"))

    out = F.when((k == 2) & (more == 0), of(2, 0)).when((k == 2) & (more == 1), of(2, 1)).when(k == 2, of(2, 2))
    return out.when(more == 0, of(1, 0)).otherwise(of(1, 1))


def keyed(lines: DataFrame) -> DataFrame:
    """Keys of every line: ``key, tag, line``; the tag is the line's id, plus 1 where the key is of a segment of its own.

    Generators over small tables, so that one short expression makes all keys.
    """
    d = lines.withColumn("n", F.char_length("line")).filter(F.col("n") >= EDITS_FROM[0])
    # the bytes of an ASCII line: a substring of these is cut without counting characters
    plain = F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary"))
    d = d.select("line_id", "line", "n", plain.alias("plain"), F.inline(_lengths(F.col("n"))))
    # even segments, the last ones a character longer
    d = d.select("line_id", "line", "n", "plain", "k", "more", F.expr("cast((n - more) div (k + 1) as int)").alias("base"), (F.col("k") + 1 - (F.col("n") - F.col("more")) % (F.col("k") + 1)).alias("short"))
    d = d.select("line_id", "line", "n", "plain", "more", "base", "short", F.inline(_places(F.col("k"), F.col("more"))))
    before = F.col("i") - 1
    at = 1 + before * F.col("base") + F.greatest(F.lit(0), before - F.col("short")) + F.col("shift")
    size = F.col("base") + F.when(F.col("short") < F.col("i"), 1).otherwise(0)
    # a place outside the line would give a shorter substring, and no other line has it under this key
    at = F.greatest(at, F.lit(1))
    text = F.when(F.col("plain").isNotNull(), F.substr("plain", at, size).cast("string")).otherwise(F.substr("line", at, size))
    key = F.xxhash64(F.col("n") - F.col("more"), "i", text)
    return d.select(key.alias("key"), F.col("line_id").bitwiseOR(F.col("own").cast("bigint")).alias("tag"), "line")


def within(a: Column, b: Column, k: int = 2) -> Column:
    """Edit distance of two strings up to k, else k + 1: bit-parallel, in a band of 2k + 1 diagonals.

    Bit k of the band is the main diagonal, lower bits are rows above.  The
    distance is followed along it over the shorter string and then, one step for
    each character that the other has more, down to the last cell.
    """
    w = 2 * k + 1
    full = (1 << w) - 1

    def band(p: Column, t: Column) -> Column:
        """Step through t; p is at least as long as t, by at most k."""
        start = F.struct(F.lit(full & ~((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(0).alias("d"))

        def step(s: Column, j: Column) -> Column:
            c = F.get(t, j)
            hit = F.lit(0)
            for x in range(w):
                hit = hit + F.when(F.get(p, j - k + x) == c, F.lit(1 << x)).otherwise(F.lit(0))

            def move(pm: Column) -> Column:
                carry = ((pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(pm).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full))

                def rest(d0: Column) -> Column:
                    hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"])).bitwiseAND(F.lit(full)))
                    hn = d0.bitwiseAND(s["vp"])
                    down = F.shiftright(d0, 1)
                    vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full)))
                    vn = down.bitwiseAND(hp)
                    return F.struct(vp.alias("vp"), vn.alias("vn"), (s["d"] + F.when(F.shiftright(d0, k).bitwiseAND(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(0))).alias("d"))

                return F.element_at(F.transform(F.array(carry), rest), 1)

            return F.element_at(F.transform(F.array(hit), move), 1)

        def last(s: Column) -> Column:
            d = s["d"]
            for x in range(k):  # vertical steps below the main diagonal
                bit = 1 << (k + x)
                step_ = F.when(s["vp"].bitwiseAND(F.lit(bit)) != 0, F.lit(1)).when(s["vn"].bitwiseAND(F.lit(bit)) != 0, F.lit(-1)).otherwise(F.lit(0))
                d = d + F.when(F.size(p) - F.size(t) > x, step_).otherwise(F.lit(0))
            return d

        return F.when(F.size(t) == 0, F.size(p)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step, last))

    chars = lambda s: F.split(s, "")
    order = F.char_length(a) >= F.char_length(b)
    p, t = F.when(order, a).otherwise(b), F.when(order, b).otherwise(a)
    value = F.element_at(F.transform(F.array(F.struct(chars(p).alias("p"), chars(t).alias("t"))), lambda x: band(x["p"], x["t"])), 1)
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > k, F.lit(k + 1)).when(F.least(F.char_length(a), F.char_length(b)) == 0, F.least(F.greatest(F.char_length(a), F.char_length(b)), F.lit(k + 1))).otherwise(F.least(value, F.lit(k + 1)))


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no`` (from 0), ``line`` and ``line_id`` (an even 64-bit hash); lines without a word are left out."""
    lines = docs.select(F.col("doc_id").cast("bigint"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(f"[^{_BLANKS}]")).withColumn("line_id", F.xxhash64("line").bitwiseAND(F.lit(-2)))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs
    for c in "ab":
        both = both.join(texts.select(F.col("id").alias(c), F.col("line").alias(f"{c}_line")), c)
    u, v = F.col("a_line"), F.col("b_line")
    shorter = F.least(F.char_length(u), F.char_length(v))
    return both.filter(within(u, v) <= tolerated(shorter)).select("a", "b").distinct()


def _grams(line: Column) -> Column:
    """Triples of characters as a set of hashes: the k-th occurrence of a triple is an element of its own.

    Equal triples stand together once sorted, and each run of them is numbered from its start: linear after the sort.
    """
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def numbered(g: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))
        return let(starts, lambda s: F.flatten(F.transform(s, lambda at, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(s, k + 1), F.size(g)) - at - 1), lambda n: F.xxhash64(F.get(g, at), n)))))

    triples = lambda c: F.array_sort(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda j: F.xxhash64(F.get(c, j), F.get(c, j + 1), F.get(c, j + 2))))
    return let(let(F.split(line, ""), triples), numbered)


def _reach(n: Column, m: Column) -> Column:
    """Elements of _grams in which linked lines of n + 2 and m + 2 characters differ at most: an edit changes three triples to three others."""
    return 6 * tolerated(F.least(n, m) + 2)


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal and near-equal lines.

    Input: ``doc_id, text``; other columns are ignored.  Returns ``(lines,
    links)``: every line with a word, as ``doc_id, line_no, class_doc_id,
    class_line_no, copy`` (the first place of its class by doc_id and line
    number, null ids last, and whether this line isn't it); and all verified pairs
    of distinct lines ``a, b`` by line hash, of which those that classes don't need
    are computed when ``links`` is read.

    A null or empty text, and lines without a word, give no rows; rows that
    repeat a doc_id share the places of equal line numbers; an empty table gives
    no rows; a very long line is cut, hashed and compared whole, in time linear in it but for
    one sort.  Two different lines count as equal with probability 2**-63 a pair.
    """
    lines = lines_of(docs)
    keys = keyed(lines)
    own = F.col("tag").bitwiseAND(F.lit(1))
    id_ = F.col("tag").bitwiseAND(F.lit(-2)).alias("id")
    # most keys belong to one line, and are gone after this aggregation
    per_key = keys.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"), F.bit_or("tag").alias("tag"))
    # a table of its own, so that its true size decides how it is joined
    shared = written(per_key.filter((own == 1) & (F.shiftright("lo", 1) != F.shiftright("hi", 1))).select("key"))
    if shared.count() <= BROADCAST_KEYS:
        found = written(keys.join(F.broadcast(shared), "key").distinct())
        texts = found.select(id_, "line").distinct()
    else:  # texts stay where they are
        found = written(keys.select("key", "tag").join(shared, "key").distinct())
        texts = lines.select(F.col("line_id").alias("id"), "line").join(found.select(id_).distinct(), "id").distinct()
    texts = written(texts)
    members = found.groupBy("key", id_).agg((F.max(own) == 1).alias("indexed"))
    members = written(members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key"))

    few, many = members.filter(F.col("size") <= PAIRED), members.filter(F.col("size") > PAIRED)
    x, y = few.filter("indexed").alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id"))).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    groups = written(led(many.select("key", "id")))
    pairs = written(pairs.unionAll(groups.select(F.least("g", "id").alias("a"), F.greatest("g", "id").alias("b"))).filter("a < b").distinct())
    links = written(_linked(pairs, texts))
    components = connected_components(links)

    # groups whose members are still apart
    placed = groups.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("g").agg(F.min("component").alias("u"), F.max("component").alias("v")).filter("u < v").select("g")
    rest = written(placed.join(open_, "g"))
    compared = pairs
    if not rest.isEmpty():
        used = rest.select("id").unionAll(rest.select("g")).distinct()
        grams = written(texts.join(used, "id").select("id", _grams(F.col("line")).alias("elements")))
        more = written(beyond_leaders(rest, grams, _reach, True).join(pairs, ["a", "b"], "left_anti"))
        links, compared = links.unionAll(written(_linked(more, texts))), pairs.unionAll(more)
        components = connected_components(links)
    hot = many.select("key", "id", "indexed").join(texts, "id").withColumn("mask", _letters(F.col("line"))).drop("line")
    hot = block_pairs(hot).filter((F.col("x.indexed") | F.col("y.indexed")) & (F.bit_count(F.col("x.mask").bitwiseXOR(F.col("y.mask"))) <= 4))
    hot = hot.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(compared, ["a", "b"], "left_anti")
    links = links.unionAll(_linked(hot, texts))

    # a place as one number, which a hash aggregate can keep the least of; null ids last
    unit, beyond = F.lit(1 << 32).cast("decimal(12,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")
    place = (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), beyond) * unit + F.col("line_no").cast("decimal(12,0)")).cast("decimal(38,0)")
    placed = written(lines.drop("line")).join(components.withColumnRenamed("id", "line_id"), "line_id", "left").select("doc_id", "line_no", F.coalesce("component", "line_id").alias("class"))
    first = placed.groupBy("class").agg(F.min(place).alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    line_no = F.pmod("c", unit)
    first = first.select("class", line_no.cast("int").alias("class_line_no"), ((F.col("c") - line_no) / unit).cast("decimal(20,0)").alias("i"))
    first = first.select("class", "class_line_no", F.when(F.col("i") < beyond, F.col("i").cast("bigint")).alias("class_doc_id"))
    out = placed.join(first, "class", "left")
    same = F.col("class_line_no").isNull() | (F.col("class_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("class_line_no") == F.col("line_no")))
    own_doc = F.when(F.col("class_line_no").isNull(), F.col("doc_id")).otherwise(F.col("class_doc_id"))
    return out.select("doc_id", "line_no", own_doc.alias("class_doc_id"), F.coalesce("class_line_no", "line_no").alias("class_line_no"), (~same).alias("copy")), links


def _letters(line: Column) -> Column:
    """Parity of each character (by code point modulo 64) as the bits of an integer."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 64)))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that are copies removed; columns stay, null texts stay null."""
    lines, _ = line_classes(docs)
    gone = lines.filter("copy").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id")).join(gone.withColumnRenamed("doc_id", "id"), "id", "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return d.select(*((F.array_join(kept, "\n") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    lines, _ = line_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "class_doc_id", F.col("class_line_no").cast("bigint").alias("class_line_no"), "copy")
