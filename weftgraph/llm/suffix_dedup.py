"""Suffix-array dedup: suffixes radix-sorted through a fixed number of bytes, most significant digit first.

A suffix of a text is sorted through ``width`` bytes only; suffixes that are equal that
far are one repeated window.  Any fixed order of the digits gives the same groups, and
a group of one is done as soon as it is alone.  Sorting all suffixes by their first
bytes would move every one of them, so the passes take their digits in this order:

1. The most significant digit of a suffix is the smallest ``gram`` bytes (by hash) within
   its window.  Neighbouring suffixes have it in common and travel as one *run*: its
   digit, the hash of all its bytes, its place.  One exchange by the digit.  A run alone
   in its digit is unique and leaves (two thirds of all text); of runs equal in
   all bytes every later one is a repetition, and leaves decided.
2. What is left, one run for each different text around a repeated digit, goes back to the
   documents for its bytes.  One exchange, again by the digit; then the windows are sorted by
   digits of five bytes, from the first to the last of the ``width``, groups of one dropping
   out at each pass.  What is left at the end are the repeated windows.

Hot digits: within a batch of 4 MB equal runs are settled at once, so that a passage in every
document sends one row a batch.  A digit with more than ``FEW`` texts in a batch or ``MANY`` in
all (near copies of one document) isn't sorted in one task: the windows of its runs are dealt
by a hash of all their bytes, after those that a batch repeats are settled there.

Equal runs, and hot windows within a batch, are told by 64-bit hashes (two different ones are taken as equal
with probability 2**-64 a pair); windows in the last pass by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import tasks, text_batches, written

#: Text bytes whose runs meet in one group of the first pass; suffixes in one group of the second.
BUCKET_BYTES = 32 << 20
BUCKET_SUFFIXES = 1 << 20
#: Different texts around a digit in a batch, and in all, beyond which its windows are dealt singly.
FEW, MANY = 8, 256
#: Suffixes that are scanned at once.
PIECE = 1 << 20
DIGIT = 5

_REPEATED, _OPEN, _HOT = 0, 1, 2
_RUNS = "bucket int, keys array<int>, contexts array<bigint>, ids array<bigint>, tags array<int>, starts array<int>, counts array<int>"
_PLACES = "doc_id bigint, tag int, kind int, start int, n int, deal int"
_SEGMENTS = "bucket int, bytes binary, ids array<bigint>, tags array<int>, starts array<int>, counts array<int>"
_ODD = 0x9E3779B97F4A7C15


def gram_of(width: int) -> int:
    """Bytes of the first digit: the largest power of two up to a third of the window."""
    gram = 1
    while gram * 2 <= width // 3:
        gram *= 2
    return gram


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h, size, base = W._RANDOM[data], 1, _ODD
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        size, base = size * 2, base * base % (1 << 64)
    return W.mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def suffix_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes with the same first digit: ``(start, count, key, context)``.

    Suffixes with less than ``width`` bytes to the end of their row have no window.
    ``key`` hashes the digit, ``context`` all bytes of the run and the digit's place in it.
    """
    gram = gram_of(width)
    found = []
    for lo in range(0, len(data) - width + 1, PIECE):
        part = data[lo : lo + PIECE + width - 1]
        h = _gram_hashes(part, gram)
        # the least hash; of equal ones the first
        at = _least((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
        at = (at & np.uint64(0xFFFFFFFF)).astype(np.int64)
        crossing = np.zeros(len(part) + 1, np.int32)
        ends = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, lo + len(part), "left")] - lo
        np.add.at(crossing, np.maximum(ends - width + 1, 0), 1)
        np.add.at(crossing, ends, -1)
        s = np.flatnonzero(np.cumsum(crossing[: len(at)]) == 0)
        if not len(s):
            continue
        at = at[s]
        new = np.ones(len(s), bool)
        new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(s)))
        s, at = s[first], at[first]
        up, down = W._power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(W._RANDOM[part] * up[:-1], out=total[1:])
        context = W.mix((total[s + count + width - 1] - total[s]) * down[s] + (at - s).astype(np.uint64) * np.uint64(_ODD)) ^ W.mix(count.astype(np.uint64))
        found.append((s + lo, count, W.mix(h[at] + np.uint64(_ODD)), context))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _after(new: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows start later than the first of their group; rows are sorted by group, id and start."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (ids > ids[head]) | ((ids == ids[head]) & (starts > starts[head]))


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _joined(ids, tags, starts, counts) -> tuple[np.ndarray, ...]:
    """Neighbouring places as one, each of ``counts`` suffixes."""
    order = np.lexsort((starts, tags, ids))
    ids, tags, starts, counts = ids[order], tags[order], starts[order].astype(np.int64), counts[order].astype(np.int64)
    new = _changes(ids, tags)
    new[1:] |= starts[1:] != starts[:-1] + counts[:-1]
    head = np.flatnonzero(new)
    return ids[head], tags[head], starts[head].astype(np.int32), np.add.reduceat(counts, head).astype(np.int32) if len(head) else counts.astype(np.int32)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their bucket, the buckets, and the rows of each."""
    turn = np.argsort(bucket, kind="stable")
    own, counts = np.unique(bucket[turn], return_counts=True)
    return turn, own.astype(np.int32), counts


def _settled(ids: np.ndarray) -> np.ndarray:
    """A bucket of its own for what a batch has decided already."""
    return np.array([-1 - int(W.mix(ids[:1].astype(np.int64).view(np.uint64))[0] >> np.uint64(34))], np.int32)


def _rows_of(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    batch = batch.filter(batch.column("doc_id").is_valid())
    return batch, batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()


def _first_digits(width: int, buckets: int):
    """Runs of a batch, dealt by their first digit; those that an equal run of the batch precedes are decided."""
    fields = ["bucket", "keys", "contexts", "ids", "tags", "starts", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.resliced(batches, 4 << 20, text=2):
            batch, doc, tag = _rows_of(batch)
            data, offsets = W.utf8(batch.column("text"))
            starts, counts, keys, contexts = suffix_runs(data, offsets, width)
            if not len(starts):
                continue
            row = np.searchsorted(offsets, starts, "right") - 1
            ids, tags, starts = doc[row], tag[row], (starts - offsets[row]).astype(np.int32)
            order = np.lexsort((starts, ids, contexts, keys))
            new = _changes(keys[order], contexts[order])
            later = np.zeros(len(order), bool)
            later[order] = _after(new, ids[order], starts[order])
            # texts of each digit in this batch
            digit = np.cumsum(_changes(keys[order])) - 1
            many = np.bincount(digit, weights=new) > FEW
            hot = np.zeros(len(order), bool)
            hot[order] = many[digit]
            hot &= ~later
            note = order[np.flatnonzero(_changes(digit))[many]]
            send = np.concatenate([np.flatnonzero(~later & ~hot), note])
            turn, own, n = _dealt(_bucket(keys[send], buckets))
            size = np.concatenate([counts[send[: len(send) - len(note)]], np.zeros(len(note), np.int64)])[turn].astype(np.int32)
            send = send[turn]
            yield pa.RecordBatch.from_arrays([pa.array(own), W.lists(pa.array(keys[send].astype(np.uint32).view(np.int32)), n), W.lists(pa.array(contexts[send].view(np.int64)), n), W.lists(pa.array(ids[send]), n), W.lists(pa.array(tags[send]), n), W.lists(pa.array(starts[send]), n), W.lists(pa.array(size), n)], fields)
            done = _joined(ids[later], tags[later], starts[later], counts[later])
            kinds = np.concatenate([np.full(len(done[0]), _REPEATED, np.int32), np.full(int(hot.sum()), _HOT, np.int32)])
            if len(kinds):
                n = np.array([len(kinds)])
                ids, tags, starts, counts = (np.concatenate([a, b[hot]]) for a, b in zip(done, (ids, tags, starts, counts.astype(np.int32)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_settled(doc)), W.lists(pa.array(kinds), n), W.lists(pa.array(np.zeros(len(kinds), np.int64)), n), W.lists(pa.array(ids), n), W.lists(pa.array(tags), n), W.lists(pa.array(starts), n), W.lists(pa.array(counts), n)], fields)

    return run


def _places(ids, tags, kinds, starts, counts, deal) -> pa.Table:
    return pa.Table.from_arrays([pa.array(ids), pa.array(tags), pa.array(kinds), pa.array(starts), pa.array(counts), pa.array(deal)], ["doc_id", "tag", "kind", "start", "n", "deal"])


def _runs_decided(key: tuple, table: pa.Table) -> pa.Table:
    """Of one group of digits: runs after an equal one are repeated, what differs around a digit stays open."""
    keys, contexts, ids, tags, starts, counts = (W.split_lists(table.column(c))[0] for c in ("keys", "contexts", "ids", "tags", "starts", "counts"))
    bucket = key[0].as_py()
    if bucket < 0:
        return _places(ids, tags, keys, starts, counts, np.zeros(len(ids), np.int32))
    noted = np.unique(keys[counts == 0])
    order = np.lexsort((starts, ids, contexts, keys))
    order = order[counts[order] > 0]
    keys, contexts, ids, tags, starts, counts = (x[order] for x in (keys, contexts, ids, tags, starts, counts))
    new = _changes(keys, contexts)
    later = _after(new, ids, starts)
    digit = np.cumsum(_changes(keys)) - 1
    texts = np.bincount(digit, weights=new)[digit]
    hot = (texts > MANY) | np.isin(keys, noted)
    kinds = np.where(hot, _HOT, _OPEN).astype(np.int32)
    left = ~later & (hot | (texts > 1))
    done = _joined(ids[later], tags[later], starts[later], counts[later])
    deal = (W.mix(keys[left].view(np.uint32).astype(np.uint64) + np.uint64(bucket * _ODD % (1 << 64))) >> np.uint64(33)).astype(np.int32)
    joined = [np.concatenate([a, b[left]]) for a, b in zip(done, (ids, tags, starts, counts), strict=True)]
    n = len(done[0])
    return _places(joined[0], joined[1], np.concatenate([np.full(n, _REPEATED, np.int32), kinds[left]]), joined[2], joined[3], np.concatenate([np.zeros(n, np.int32), deal]))


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first, first + 1, ...`` for each count, and whose each is."""
    of = np.repeat(np.arange(len(counts)), counts)
    return first[of] + np.arange(len(of)) - (np.cumsum(counts) - counts)[of], of


def _open_bytes(width: int, buckets: int):
    """Bytes of the open runs, dealt by their digit; hot windows singly, by all their bytes."""
    fields = ["bucket", "bytes", "ids", "tags", "starts", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.resliced(batches, 4 << 20, text=2):
            batch = batch.filter(batch.column("open").is_valid())
            if not len(batch):
                continue
            batch, doc, tag = _rows_of(batch)
            data, offsets = W.utf8(batch.column("text"))
            places, per_row = W.split_places(batch.column("open"), ("start", "n", "kind", "deal"))
            row = np.repeat(np.arange(len(batch)), per_row)
            start, n, kind, deal = (places[c].astype(np.int64) for c in ("start", "n", "kind", "deal"))
            is_open = kind == _OPEN
            at, of = _spread(start[~is_open], n[~is_open])
            hot_row = row[~is_open][of]
            h = _window_hashes(data, at + offsets[hot_row], width)
            ids = doc[hot_row]
            order = np.lexsort((at, ids, h))
            later = np.zeros(len(at), bool)
            later[order] = _after(_changes(h[order]), ids[order], at[order])
            group = np.concatenate([(deal[is_open] * buckets >> 31), _bucket(h[~later], buckets)]).astype(np.int32)
            rows = np.concatenate([row[is_open], hot_row[~later]])
            starts = np.concatenate([start[is_open], at[~later]])
            counts = np.concatenate([n[is_open], np.ones(int((~later).sum()), np.int64)])
            turn, own, per = _dealt(group)
            rows, starts, counts = rows[turn], starts[turn], counts[turn]
            to = np.cumsum(per)
            blobs = []
            for a, b in zip(to - per, to, strict=True):
                place, _ = _spread((starts + offsets[rows])[a:b], counts[a:b] + width - 1)
                blobs.append(data[place].tobytes())
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(blobs, pa.binary()), W.lists(pa.array(doc[rows]), per), W.lists(pa.array(tag[rows]), per), W.lists(pa.array(starts.astype(np.int32)), per), W.lists(pa.array(counts.astype(np.int32)), per)], fields)
            if later.any():
                done = _joined(ids[later], tag[hot_row[later]], at[later], np.ones(int(later.sum()), np.int64))
                per = np.array([len(done[0])])
                yield pa.RecordBatch.from_arrays([pa.array(_settled(doc)), pa.array([b""], pa.binary()), *(W.lists(pa.array(x), per) for x in done)], fields)

    return run


def _window_hashes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that start at ``at``, in pieces."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), PIECE // 8):
        here = at[lo : lo + PIECE // 8]
        h = np.zeros(len(here), np.uint64)
        for k in range(width):
            h *= np.uint64(_ODD)
            h += W._RANDOM[data[here + k]]
        out[lo : lo + len(here)] = W.mix(h)
    return out


def radix_groups(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that start at ``at`` and have equals: ``(index into at, group)``, in order of group.

    Most significant digit first: each pass sorts what is left by group and the next
    ``DIGIT`` bytes, splits groups where the digit changes, and drops groups of one.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data), ">u8", padded.tobytes(), strides=(1,))
    index, group = np.arange(len(at)), np.zeros(len(at), np.uint64)
    for depth in range(0, width, DIGIT):
        digit = words[at[index] + depth].astype(np.uint64) >> np.uint64(64 - 8 * min(DIGIT, width - depth))
        key = (group << np.uint64(8 * DIGIT)) | digit
        order = np.argsort(key, kind="stable")
        key, index = key[order], index[order]
        new = _changes(key)
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        keep = np.repeat(size > 1, size)
        index, group = index[keep], (np.cumsum(new[keep]) - 1).astype(np.uint64)
    return index, group


def _windows_decided(width: int):
    """Of one group: the windows that start after an equal one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, tags, starts, counts = (W.split_lists(table.column(c))[0] for c in ("ids", "tags", "starts", "counts"))
        if key[0].as_py() >= 0:
            data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
            counts = counts.astype(np.int64)
            at, of = _spread(np.cumsum(counts + width - 1) - (counts + width - 1), counts)
            place = starts[of] + at - (np.cumsum(counts + width - 1) - (counts + width - 1))[of]
            index, group = radix_groups(data, at, width)
            order = np.lexsort((place[index], ids[of[index]], group))
            index, group = index[order], group[order]
            index = index[_after(_changes(group), ids[of[index]], place[index])]
            ids, tags, starts, counts = _joined(ids[of[index]], tags[of[index]], place[index], np.ones(len(index), np.int64))
        zero = np.zeros(len(ids), np.int32)
        return _places(ids, tags, zero, starts, counts, zero)

    return run


def _cut(width: int):
    """What is left of each text without the repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.resliced(batches, 4 << 20, text=2):
            data, offsets = W.utf8(batch.column("text"))
            places, per_row = W.split_places(batch.column("gone"), ("start", "n"))
            at = places["start"].astype(np.int64) + np.repeat(offsets[:-1], per_row)
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + places["n"] + width - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept, digests, removed, spans = [], [], [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                mine = gone[lo:hi]
                text = data[lo:hi][~mine].tobytes()
                edge = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
                kept.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
                removed.append(int(mine.sum()))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "removed"],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = 100, bucket_bytes: int = BUCKET_BYTES, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """Remove the bytes covered by ``width``-byte strings that also start earlier.

    Input: ``doc_id`` bigint and ``text``; other columns are ignored.  Texts are their
    UTF-8 bytes; matches don't cross documents.  Earlier is a smaller ``doc_id``, or the
    same and a smaller start; overlapping repetitions count.  Output per row: ``doc_id,
    n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept`` (bytes: a cut may fall
    inside a character), ``kept_sha256, removed``.

    Defined cases: a null or empty text has no bytes; a text shorter than ``width`` keeps
    all; a row with a null ``doc_id`` is neither compared nor cut; rows that repeat a
    ``doc_id`` count as that document, each with its own starts, so that equal rows don't
    remove each other; of a text that repeats one byte a million times only the first stays,
    as the second window starts there; very long texts are scanned in pieces; an empty table gives
    no rows.
    """
    text_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    sizes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # different texts under one doc_id are told apart; that costs four bytes a run, so only where there are any
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    tag = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if repeated else F.lit(0)
    docs = docs.select("doc_id", tag.alias("tag"), "text")
    buckets = max(1, -(-sizes // bucket_bytes))
    runs = docs.mapInArrow(_first_digits(width, buckets), _RUNS).repartition(tasks(buckets), "bucket")
    places = written(runs.groupBy("bucket").applyInArrow(_runs_decided, _PLACES))
    opened = places.filter(F.col("kind") != _REPEATED)
    suffixes = opened.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-suffixes // bucket_suffixes))
    by_doc = opened.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "kind", "deal")).alias("open"))
    # a left join here too, so that both joins read one exchange of the texts
    segments = docs.join(by_doc, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "open").mapInArrow(_open_bytes(width, buckets), _SEGMENTS)
    late = segments.repartition(tasks(buckets), "bucket").groupBy("bucket").applyInArrow(_windows_decided(width), _PLACES)
    gone = places.filter(F.col("kind") == _REPEATED).unionByName(late).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    out = docs.join(gone, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "gone")
    return out.mapInArrow(_cut(width), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, removed array<struct<first:int,end:int>>")


def op13_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP13_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 200 <= len(h) THEN substr(h, 2 * i + 1, 200) END AS k FROM p),
f AS (SELECT doc_id, i, b, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
