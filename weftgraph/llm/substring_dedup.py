"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark.

Plan
----
1. ``mapInArrow``: hash every ``width``-word window of every document.  Within
   a batch of 4 MB a window that also starts in a smaller ``doc_id`` of the batch
   is already known to be repeated; of the others one row per distinct hash goes
   on.  A window shared by a third of all documents therefore sends at most one
   row per batch to the exchange.
2. One exchange on a hash range: the smallest ``doc_id`` of each hash decides the
   rest.
3. The repeated hashes come back to their document, whose covered words merge
   into maximal removal intervals.

Rows travel as arrays (one per batch and hash range), so the exchange carries
about nine bytes a window.  Two different windows get the same 64-bit hash with
probability 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import tasks, text_batches

#: Text bytes whose windows meet in one task of the second stage.
BUCKET_BYTES = 8 << 20
_SHUFFLED = "bucket int, hashes array<bigint>, ids array<bigint>"


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _cover(seen: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Every ``width``-th window of each run of seen windows, and its last: they cover the same words."""
    if not len(seen):
        return seen
    new = seen.copy()
    new[1:] &= ~(seen[:-1] & (row[1:] == row[:-1]))
    last = seen.copy()
    last[:-1] &= ~(seen[1:] & (row[1:] == row[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(seen)), 0))
    return seen & (((np.arange(len(seen)) - start) % width == 0) | last)


def _hash_windows(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.resliced(batches, 4 << 20):
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            data, offsets = W.utf8(batch.column(1).take(pa.array(order)))
            ids = ids[order]
            found, owner, rows = [], [], []
            for lo, hi in W.slices(offsets, 2 << 20):
                at = offsets[lo : hi + 1]
                words = W.scan(data[at[0] : at[-1]], at - at[0], W.NOT_SPACE, False)
                first, hashes = W.windows(words, width)
                found.append(hashes)
                rows.append(lo + words.row[first])
                owner.append(ids[rows[-1]])
            if not found or not sum(map(len, found)):
                continue
            hashes, owner = np.concatenate(found), np.concatenate(owner)
            by_hash = np.argsort(hashes, kind="stable")  # ids ascend within a hash
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[by_hash[1:]] != hashes[by_hash[:-1]]
            least = owner[by_hash[np.flatnonzero(new)]][np.cumsum(new) - 1]
            seen = np.zeros(len(hashes), bool)
            seen[by_hash[owner[by_hash] > least]] = True
            open_ = np.zeros(len(hashes), bool)
            open_[by_hash[new]] = True
            kind = _bucket(hashes[open_], buckets)
            turn = np.argsort(kind.astype(np.uint16) if buckets < 65536 else kind, kind="stable")
            own, counts = np.unique(kind[turn], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), W.lists(pa.array(hashes[open_][turn].view(np.int64)), counts), W.lists(pa.array(owner[open_][turn]), counts)], ["bucket", "hashes", "ids"])
            seen = _cover(seen, np.concatenate(rows), width)
            if seen.any():
                there = buckets + np.array([int(ids[0]) % buckets], np.int32)
                n = np.array([int(seen.sum())])
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), W.lists(pa.array(hashes[seen].view(np.int64)), n), W.lists(pa.array(owner[seen]), n)], ["bucket", "hashes", "ids"])

    return run


def _decide(buckets: int):
    def run(key, table):
        hashes, _ = W.split_lists(table.column("hashes"))
        ids, _ = W.split_lists(table.column("ids"))
        hashes = hashes.view(np.uint64)
        if key[0].as_py() < buckets:
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            later = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            hashes, ids = hashes[later], ids[later]
        return pa.Table.from_arrays([pa.array(ids), pa.array(hashes.view(np.int64))], ["doc_id", "hash"])

    return run


def _cut(width: int):
    """Words outside every repeated window, their digest, and the removed word intervals."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            bytes_, ends = W.utf8(whole.column(1))
            for lo, hi in W.slices(ends, 2 << 20):
                batch = whole.slice(lo, hi - lo)
                data, offsets = bytes_[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                words = W.scan(data, offsets, W.NOT_SPACE, False)
                at, hashes = W.windows(words, width)
                row = words.row[at]
                flat, counts = W.split_lists(batch.column(2))
                flat = flat.astype(np.int64).view(np.uint64)
                to = np.cumsum(counts)
                covered = np.zeros(len(words.start) + 1, np.int64)
                bounds = np.searchsorted(row, np.arange(len(batch) + 1))
                for i in np.flatnonzero(counts):
                    mine = slice(bounds[i], bounds[i + 1])
                    hit = at[mine][np.isin(hashes[mine], flat[to[i] - counts[i] : to[i]])]
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + width, -1)
                gone = np.cumsum(covered)[:-1] > 0
                digests, texts, spans = [], [], []
                raw = data.tobytes()
                for i in range(len(batch)):
                    a, b = words.first[i], words.first[i + 1]
                    keep = np.flatnonzero(~gone[a:b]) + a
                    if len(keep) == b - a and not len(keep):
                        text = b""
                    else:
                        text = b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode("utf-8", "replace"))
                    g = np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))
                    spans.append([{"first": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(g == 1), np.flatnonzero(g == -1), strict=True)])
                total = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(words.count.astype(np.int64)),
                        pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)),
                        pa.array(texts),
                        pa.array(digests),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "removed"],
                )

    return run


def _width_of(docs: DataFrame, bucket_bytes: int) -> int:
    """Hash ranges such that one holds the windows of about ``bucket_bytes`` of text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return int(min(2_000_000, max(1, -(-total // bucket_bytes))))


def remove_repeated_windows(docs: DataFrame, width: int = 13, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove the words covered by windows that start in an earlier document.

    Input: ``doc_id`` bigint and ``text``; other columns are ignored.  Words are
    runs of ``[^\\x20\\x09-\\x0D]``.  A word goes if a window of ``width`` words
    covering it also starts in a document with a smaller ``doc_id``.  Output per
    row: ``doc_id, n_words, n_removed, kept, kept_sha256, removed``.

    Defined cases: a null or empty text has no words and keeps the empty text;
    a row with a null ``doc_id`` is neither compared nor cut; rows that repeat a
    ``doc_id`` never remove each other's words but are cut alike; fewer words
    than ``width`` have no window; an empty table gives no rows.
    """
    text_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    buckets = _width_of(docs, bucket_bytes)
    hashed = docs.mapInArrow(_hash_windows(width, buckets), _SHUFFLED)
    flags = hashed.repartition(tasks(buckets), "bucket").groupBy("bucket").applyInArrow(_decide(buckets), "doc_id bigint, hash bigint")
    flags = flags.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))
    joined = docs.join(flags, "doc_id", "left").select("doc_id", "text", "hashes")
    return joined.mapInArrow(_cut(width), "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string, removed array<struct<first:int,end:int>>")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT doc_id, i FROM win JOIN least_ USING (k) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
