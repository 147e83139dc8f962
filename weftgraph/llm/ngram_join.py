"""N-gram Jaccard join by parity sketches.

Every document is the set of its distinct 5-word shingles.  Two sets of sizes
p and q with Jaccard >= t differ in at most (1-t)/(1+t) * (p+q) shingles.

* **Parity sketch.**  A sketch word is the XOR of the hashes of the shingles that
  fall to it, so each differing shingle changes at most one word: the distance of
  two sketches, in words, never exceeds the symmetric difference.  (With one-hot
  bits for hashes the same holds for bits; that form is used where sketches are
  compared, and this one where they are joined, as a lone one-hot bit says little.)
* **Size bands.**  Sizes are cut into intervals of ratio 1/t, in each of which
  pairs differ in at most d shingles.  The sketch has more than d / 2 groups of
  three words, so in some group at most one word differs (pigeonhole), and two of
  its three words agree: those pairs of words are the join keys, each of about
  six shingles.  A document is probed in its own interval and in the next one.
* **Frequent shingles** (passages that many documents share) would make frequent
  keys.  Rows differ no more without them than with them, so the first sketch
  covers the other shingles only; any set of shingles may be left out, and the
  most frequent ``COMMON`` are.
* **Pairs of zero words** say little and would be frequent keys, so they are left
  out.  A link could only be lost if every group that agrees has such a pair on
  both sides; documents with so many of them are sketched again with another
  seed, then in the same way with all their shingles, and those left after the
  last seed emit their zero pairs too.
* **Groups.**  Identical sets are one class.  Keys shared by few
  documents give all their pairs.  The members of keys shared by many (near
  copies) are compared with one leader, the member with the most such keys.  What
  is still in different components after that meets by the rarest differences to
  the leader (``beyond_leaders`` in shared.py), which copies that were changed in
  different places don't share.
* **Verification.**  Candidates pass the size bound and the Hamming bound of one-hot parity
  sketches, whose length grows with the sets, and are then compared on the whole
  sets.  The links that components don't need are found block by block when the
  table of links is read.

Shingles are 64-bit hashes; two different ones are equal with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import beyond_leaders, block_pairs, connected_components, led, tasks, text_batches, written

#: Text bytes whose keys meet in one task.
BUCKET_BYTES = 4 << 20
#: Keys with more members go under a leader instead of giving all pairs.
PAIRED = 8
SEEDS = 6
#: Frequent shingles that are left out of the first sketch, at most (8 bytes each are broadcast).
COMMON = 100_000
#: Least bits of a sketch, and bits for each differing shingle that a link allows.
SKETCH_BITS, BITS_EACH = 512, 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and their rows."""
    words = W.scan(data, offsets, W.NOT_SPACE, True)
    at, hashes = W.windows(words, n)
    rows = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):  # the whole sequence is the one shingle
        whole = []
        for i in short:
            total = np.uint64(int(words.count[i]))
            for h in words.hash[words.first[i] : words.first[i + 1]]:
                total = W.mix(np.array([total ^ h], np.uint64))[0]
            whole.append(total)
        hashes, rows = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([rows, short])
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.uint16) if len(offsets) < 65536 else rows[order], kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def _per_slice(batch: pa.RecordBatch, n: int):
    ids = batch.column(0)
    data, offsets = W.utf8(batch.column(1))
    for lo, hi in W.slices(offsets, 1 << 18):
        at = offsets[lo : hi + 1]
        hashes, rows = shingle_sets(data[at[0] : at[-1]], at - at[0], n)
        yield ids.slice(lo, hi - lo), hashes, np.searchsorted(rows, np.arange(hi - lo + 1))


def _prints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit fingerprints of each row's set."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        np.cumsum(W.mix(hashes ^ np.uint64(salt)), out=total[1:])
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]


def _sketches(hashes: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """One-hot parity sketches of all rows as 64-bit words, and the words of each row.

    A sketch's length is a power of two, about ``BITS_EACH`` bits for each shingle in which
    linked sets of that size may differ; XOR of its halves is the sketch of half the length.
    """
    differing = np.maximum(2 * sizes * (den - num) // (den + num), 1)
    bits = SKETCH_BITS << np.maximum(np.ceil(np.log2(np.maximum(BITS_EACH * differing / SKETCH_BITS, 1))).astype(np.int64), 0)
    base = np.concatenate([[0], np.cumsum(bits)])
    bit = W.mix(hashes ^ np.uint64(0xA4093822299F31D0)).view(np.int64) & (np.repeat(bits, sizes) - 1)
    flip = np.bincount(np.repeat(base[:-1], sizes) + bit, minlength=base[-1]) & 1
    return np.packbits(flip.astype(np.uint8)).view(np.int64), bits // 64


def _describe(n: int, num: int, den: int):
    """Set size, fingerprints and the parity sketch of each document.

    A row with ``n_shingles`` -1 has the shingles that occur in three or more
    documents of its batch, and how many.
    """
    names = ["doc_id", "n_shingles", "p", "q", "sketch", "shingles", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.resliced(batches, 4 << 20):
            seen = []
            for ids, hashes, first in _per_slice(batch, n):
                rows, sizes = len(ids), np.diff(first)
                p, q = _prints(hashes, first)
                sketch, words = _sketches(hashes, sizes, num, den)
                none = pa.nulls(rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), W.lists(pa.array(sketch), words), none, none], names)
                seen.append(hashes)
            all_ = np.sort(np.concatenate(seen)) if seen else np.empty(0, np.uint64)
            start = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.empty(0, np.int64)
            counts = np.diff(np.append(start, len(all_)))
            many = counts >= 3
            if many.any():
                none = pa.nulls(1, pa.int64())
                k = np.array([int(many.sum())])
                yield pa.RecordBatch.from_arrays([none, pa.array([-1], pa.int64()), none, none, pa.nulls(1, pa.list_(pa.int64())), W.lists(pa.array(all_[start][many].view(np.int64)), k), W.lists(pa.array(counts[many].astype(np.int64)), k)], names)

    return run


def _common(described: DataFrame, most: int) -> np.ndarray:
    """The most frequent shingles, ascending; at most ``most``."""
    each = described.filter("n_shingles = -1").select(F.explode(F.arrays_zip("shingles", "counts")).alias("x")).select("x.shingles", "x.counts")
    top = each.groupBy("shingles").agg(F.sum("counts").alias("c")).orderBy(F.desc("c"), "shingles").limit(most)
    return np.sort(np.array([r[0] for r in top.select("shingles").toLocalIterator()], np.int64).view(np.uint64))


def intervals(most: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, most differing shingles d, groups of words) of each size interval.

    d errors spoil at most d // 2 groups with two errors each; the groups beyond
    that make up for some whose words are zero.
    """
    out, lo = [], 1
    while True:
        hi = max(lo, lo * den // num)
        d = (den - num) * 2 * hi // (den + num)
        out.append((lo, hi, d, d // 2 + 1 + d // 20))
        if hi > most:
            return out
        lo = hi + 1


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _signatures(hashes: np.ndarray, size_of: np.ndarray, d: np.ndarray, groups: np.ndarray, tag: np.ndarray, seed: int, last: bool):
    """Keys of the word pairs of each row, the rows, and which rows go on to the next seed.

    A row's shingles, ascending and one row after another, fall into ``groups``
    times three sketch words.
    """
    rows = len(size_of)
    row = np.repeat(np.arange(rows), size_of)
    if seed:
        hashes = W.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * seed & (1 << 64) - 1))
    base = np.concatenate([[0], np.cumsum(3 * groups)])
    place = base[row] + (((hashes >> np.uint64(32)) * (3 * groups)[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    bit = W.mix(hashes + np.uint64(0x452821E638D01377))
    if seed:  # the first seed keeps the ascending order of the hashes
        order = np.argsort(place, kind="stable")
        place, bit = place[order], bit[order]
    words = np.zeros(base[-1], np.uint64)
    if len(place):
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        words[place[new]] = np.bitwise_xor.reduceat(bit, new)
    words = words.reshape(-1, 3)
    owner = np.repeat(np.arange(rows), groups)
    number = np.arange(len(words)) - (base[:-1] // 3)[owner]
    weak = np.bincount(owner, (words == 0).sum(1) >= 2, minlength=rows)
    loose = weak >= groups - d // 2
    where = W.mix((tag[owner].astype(np.uint64) << np.uint64(40)) ^ (np.uint64(seed) << np.uint64(34)) ^ number.astype(np.uint64))
    keys, owners = [], []
    for k, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        u, v = words[:, x], words[:, y]
        use = (u | v) != 0
        if last:
            use |= loose[owner]
        keys.append(W.mix(W.mix(u[use] + where[use]) ^ v[use] ^ np.uint64(k)))
        owners.append(owner[use])
    return np.concatenate(keys), np.concatenate(owners), loose


def _emit(n: int, num: int, den: int, buckets: int, shared):
    """Keys of all sketch words, as one row of arrays per hash range and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in W.resliced(batches, 2 << 20):
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.sort_by(batch.schema.names[0])
            seen: set[tuple] = set()
            all_keys, all_ids = [], []
            for ids, hashes, first in _per_slice(batch, n):
                ids, sizes = ids.to_numpy(), np.diff(first)
                p, q = _prints(hashes, first)
                keep = []
                for i, x in enumerate(zip(sizes.tolist(), p.tolist(), q.tolist(), strict=True)):
                    if x[0] and x not in seen:
                        seen.add(x)
                        keep.append(i)
                if not keep:
                    continue
                keep = np.array(keep)
                table = intervals(int(sizes.max()) * den // num, num, den)  # up to the largest partner in any slice
                lows = np.array([x[0] for x in table])
                own = np.searchsorted(lows, sizes[keep], "right") - 1
                above = np.flatnonzero(sizes[keep] * den >= num * lows[np.minimum(own + 1, len(table) - 1)]) if len(table) > 1 else np.empty(0, int)
                above = above[own[above] + 1 < len(table)]
                row, tag = np.concatenate([keep, keep[above]]), np.concatenate([own, own[above] + 1])
                apart = np.array([x[2] for x in table])[tag] > 0  # else only equal sets are linked, and those are one class
                row, tag = row[apart], tag[apart]
                rare = ~_among(hashes, common)
                to = np.concatenate([[0], np.cumsum(rare)])
                rare_sizes, rare_first, rare_hashes = np.diff(to[first]), to[first], hashes[rare]
                for seed in range(2 * SEEDS):
                    if not len(row):
                        break
                    part, begin, size = (rare_hashes, rare_first, rare_sizes) if seed < SEEDS else (hashes, first, sizes)
                    size_of = size[row]
                    at = np.repeat(begin[row] - np.concatenate([[0], np.cumsum(size_of)[:-1]]), size_of) + np.arange(size_of.sum())
                    d, groups = (np.array([x[k] for x in table])[tag] for k in (2, 3))
                    keys, owner, loose = _signatures(part[at], size_of, d, groups, tag, seed, seed == 2 * SEEDS - 1)
                    all_keys.append(keys)
                    all_ids.append(ids[row[owner]])
                    row, tag = row[loose], tag[loose]
            if not all_keys:
                continue
            keys, owners = np.concatenate(all_keys), np.concatenate(all_ids)
            bucket = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            hot = np.zeros(len(keys), bool)
            order = np.lexsort((owners, keys))
            new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.empty(0, bool)
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(keys)))
            run_of = np.cumsum(new) - 1
            many = length[run_of] > PAIRED
            hot[order[many & new]] = True
            local = order[many]  # members of keys that are already frequent in this batch
            forward = np.ones(len(keys), bool)
            forward[order[many & ~new]] = False
            f = np.flatnonzero(forward)
            f = f[np.argsort(bucket[f].astype(np.uint16) if buckets < 65536 else bucket[f], kind="stable")]
            yield _rows(bucket[f], keys[f], owners[f], hot[f])
            if len(local):
                # nothing more meets them: each batch's go on in a group of their own, however many batches share a key
                group = -1 - int(W.mix(owners[:1].astype(np.int64).view(np.uint64))[0] >> np.uint64(34))
                yield _rows(np.full(len(local), group), keys[local], owners[local], np.ones(len(local), bool), bucket[local])

    return run


def _rows(bucket, keys, ids, hot, upper=None) -> pa.RecordBatch:
    """One row of arrays per hash range; the inputs are ordered by it.  ``upper`` are the ranges of keys that go elsewhere."""
    own, counts = np.unique(bucket, return_counts=True)
    lists = lambda x: W.lists(pa.array(x), counts)
    # the bucket holds the upper bits of the key, so the lower half is enough: a chance match is only a candidate
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    ranges = pa.nulls(len(own), pa.list_(pa.int32())) if upper is None else lists(upper.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), lists(low), lists(ids), lists(hot), ranges], ["bucket", "keys", "ids", "hot", "upper"])


def _meet():
    """Pairs of documents that share a sketch word; members of frequent words as (key, id)."""

    def run(key, table):
        bucket = key[0].as_py()
        keys, _ = W.split_lists(table.column("keys"))
        ids, _ = W.split_lists(table.column("ids"))
        base = W.split_lists(table.column("upper"))[0].astype(np.int64) if bucket < 0 else np.int64(bucket)
        full = base << np.int64(32) | keys.view(np.uint32).astype(np.int64)
        if bucket < 0:
            return _found(ids[:0], ids[:0], full, ids)
        hot = table.column("hot").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, keys))
        keys, ids, full, hot = keys[order], ids[order], full[order], hot[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(keys)))
        run_of = np.cumsum(new) - 1
        place = np.arange(len(keys)) - start[run_of]
        a, b = [], []
        few = length[run_of] <= PAIRED
        for k in range(1, PAIRED):  # the k-th member before this one in the run
            i = np.flatnonzero(few & (place >= k))
            a.append(ids[i - k])
            b.append(ids[i])
        listed = (~few) | (np.logical_or.reduceat(hot, start)[run_of] if len(keys) else few)
        return _found(np.concatenate(a), np.concatenate(b), full[listed], ids[listed])

    return run


def _found(a, b, keys, ids):
    low, high = np.minimum(a, b), np.maximum(a, b)
    apart = low < high
    pairs = np.unique(np.stack([low[apart], high[apart]], 1), axis=0) if apart.any() else np.empty((0, 2), np.int64)
    none = lambda n: pa.nulls(n, pa.int64())
    col = lambda x, n: pa.concat_arrays([x, n])
    return pa.Table.from_arrays([col(none(len(pairs)), pa.array(keys)), col(pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(ids)), col(pa.array(np.ascontiguousarray(pairs[:, 1])), none(len(ids)))], ["key", "a", "b"])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, first in _per_slice(batch, n):
                yield pa.RecordBatch.from_arrays([ids, W.lists(pa.array(hashes.view(np.int64)), np.diff(first))], ["id", "shingles"])

    return run


def _near(na, nb, u, v, num: int, den: int):
    """Size and Hamming bounds that every link keeps; a longer sketch is folded to the shorter's length."""
    least = F.least(F.size(u), F.size(v))

    def folded(s):
        parts = lambda i: F.aggregate(F.sequence(i, F.size(s) - 1, least), F.lit(0).cast("bigint"), lambda x, j: x.bitwiseXOR(F.get(s, j)))
        return F.when(F.size(s) == least, s).otherwise(F.transform(F.sequence(F.lit(0), least - 1), parts))

    apart = F.aggregate(F.zip_with(folded(u), folded(v), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = F.least(na, nb) * den >= F.greatest(na, nb) * num
    return sizes & F.when(sizes, apart * (den + num) <= (na + nb) * (den - num))


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Link documents whose shingle sets have a Jaccard similarity of num/den or more.

    Input: ``doc_id`` bigint and ``text``; other columns are ignored.  Returns
    ``(members, links)``.  ``members`` has one row per input row: ``doc_id,
    n_shingles, rep`` (smallest doc_id with the same set) and ``component_id``
    (smallest doc_id reachable by links).  ``links`` has verified pairs ``(a, b)``
    of representatives of different sets: all of them.  Those among the members of
    frequent sketch words that components don't need are computed when ``links`` is
    read (see ``link_counts`` in shared.py for each document's number of links).

    Defined cases: null, empty or blank text has the empty set, is linked with
    nothing and is its own component; fewer than ``n`` words are one shingle;
    rows that share a doc_id are one document; a null doc_id has a null
    component; an empty table gives no rows.
    """
    text_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = int(min(2_000_000, max(1, -(-total // bucket_bytes))))
    described = written(docs.mapInArrow(_describe(n, num, den), "doc_id bigint, n_shingles bigint, p bigint, q bigint, sketch array<bigint>, shingles array<bigint>, counts array<bigint>"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(described, COMMON))
    described = described.filter("n_shingles >= 0").drop("shingles", "counts")
    least = described.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "p", "q").agg(F.min("doc_id").alias("rep"))
    nodes = written(described.join(least, ["n_shingles", "p", "q"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), "sketch"))
    to_rep = nodes.select("doc_id", "rep").filter("doc_id is not null").distinct()
    reps = nodes.filter("doc_id = rep").dropDuplicates(["doc_id", "n_shingles", "sketch"]).drop("rep")

    emitted = docs.mapInArrow(_emit(n, num, den, buckets, shared), "bucket int, keys array<int>, ids array<bigint>, hot array<boolean>, upper array<int>")
    met = written(emitted.repartition(tasks(buckets), "bucket").groupBy("bucket").applyInArrow(_meet(), "key bigint, a bigint, b bigint"))
    pairs = met.filter("key is null").select("a", "b").distinct()
    for c in "ab":
        pairs = pairs.join(to_rep.select(F.col("doc_id").alias(c), F.col("rep").alias(f"r{c}")), c)
    pairs = pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    members = met.filter("key is not null").select("key", F.col("a").alias("doc_id")).join(to_rep, "doc_id").select("key", F.col("rep").alias("id")).distinct()
    members = written(members)
    groups = written(led(members))
    pairs = pairs.unionAll(groups.select(F.least("g", "id").alias("a"), F.greatest("g", "id").alias("b"))).filter("a < b").distinct()
    pairs = written(_bounded(pairs, reps, num, den))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionAll(groups.select("id")).distinct()
    sets = written(_sets_of(docs, ids, n))
    links = written(_among_sets(pairs, sets, num, den))

    twice = to_rep.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    components = connected_components(links.unionAll(twice))

    # groups whose members are still apart
    placed = groups.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("g")
    rest = written(placed.join(open_, "g"))
    compared = pairs
    if not rest.isEmpty():
        more = beyond_leaders(rest, sets.withColumnRenamed("shingles", "elements"), lambda p, q: F.floor((p + F.least(q, F.floor(p * den / num))) * (den - num) / (den + num)))
        more = written(_bounded(more, reps, num, den).join(pairs, ["a", "b"], "left_anti"))
        links, compared = links.unionAll(written(_among_sets(more, sets, num, den))), pairs.unionAll(more)
        components = connected_components(links.unionAll(twice))
    hot = block_pairs(members.select("key", "id").join(reps.withColumnRenamed("doc_id", "id"), "id"))
    hot = hot.filter(_near(F.col("x.n_shingles"), F.col("y.n_shingles"), F.col("x.sketch"), F.col("y.sketch"), num, den)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    hot = hot.distinct().join(compared, ["a", "b"], "left_anti")
    links = links.unionAll(_among_sets(hot, sets, num, den))
    out = nodes.join(components.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", "rep", F.coalesce("component", "rep").alias("component_id")), links


def _bounded(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs that the size and Hamming bounds leave possible."""
    for c in "ab":
        pairs = pairs.join(reps.select(F.col("doc_id").alias(c), F.struct("n_shingles", "sketch").alias(f"{c}_")), c)
    return pairs.filter(_near(F.col("a_.n_shingles"), F.col("b_.n_shingles"), F.col("a_.sketch"), F.col("b_.sketch"), num, den)).select("a", "b").distinct()


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(n), "id bigint, shingles array<bigint>")


def _among_sets(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("u")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("v")), "b")
    common = F.size(F.array_intersect("u", "v"))
    return both.withColumn("i", common).filter(F.col("i") * den >= (F.size("u") + F.size("v") - F.col("i")) * num).select("a", "b").distinct()


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest doc_id, all columns kept.

    A row with a null doc_id stays; of rows that repeat a kept doc_id all stay.
    """
    members, _ = jaccard_classes(docs, n, num, den)
    gone = members.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    members, _ = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return members.select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), @), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.m AS component_id FROM d LEFT JOIN s USING (doc_id) JOIN (SELECT id, min(r) AS m FROM reach GROUP BY id) c ON c.id = d.doc_id
""".replace("@", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'")
