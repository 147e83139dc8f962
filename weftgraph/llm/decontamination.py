"""Benchmark decontamination by a generalised suffix automaton of the test items.

The normalised words of all test items go into one generalised suffix automaton.
Training words stream through it; the state and the longest matching length at
each word tell which windows of test words end there.  Only stretches whose word
q-grams all occur in the test items enter the automaton: a necessary condition
of any match that NumPy checks for whole batches.

The test items are a stated set.  They are cut into words by Spark and dealt to
blocks of about ``BLOCK_WORDS`` words; each block has its own automaton (some 550
bytes a word, about 110 MB, which bounds the driver's share and the broadcast),
and the blocks follow each other as passes, without a shuffle; the usual test
sets fit one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import text_batches, written

#: Words of test items in one automaton.
BLOCK_WORDS = 200_000
_FOUND = "spans array<struct<first:int,end:int,from_byte:int,to_byte:int>>, items array<string>, n_words bigint"


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[int]]], width: int):
        self.width = width
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        n = len(self.step)
        self.items: list[set | None] = [None] * n  # on states that hold a suffix of `width` words
        self.short: list[list | None] = [None] * n  # on states that hold a whole shorter item
        for name, item in items:
            state = 0
            for i, word in enumerate(item):
                state = self.step[state][word]
                if i + 1 >= width:
                    # only the last `width` words count: from their state the next is a link away at most
                    state = self._holder(state, width)
                    self._mark(self.items, state).add(name)
            if 0 < len(item) < width:
                at = self._holder(state, len(item))
                self.short[at] = [*(self.short[at] or []), (len(item), name)]
        least = min((len(x) for _, x in items if x), default=width)
        self.least = min(width, least)
        self.q = min(4, self.least)

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            q = step[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p != -1:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        return copy

    def _holder(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words."""
        while self.link[state] != -1 and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, where: list, at: int) -> set:
        if where[at] is None:
            where[at] = set()
        return where[at]

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int, set]]:
        """(first word, end word, items) of the windows that end at each token."""
        state, size = 0, 0
        step, link, length, width = self.step, self.link, self.length, self.width
        for i, token in enumerate(tokens):
            while state and token not in step[state]:
                state = link[state]
                size = length[state]
            if token in step[state]:
                state = step[state][token]
                size += 1
            else:
                state, size = 0, 0
                continue
            if size >= width:
                # the matched length is cut to the window's, which bounds all walks to shorter suffixes by it
                state, size = self._holder(state, width), width
                if self.items[state]:
                    yield i + 1 - width, i + 1, self.items[state]
            at = state if self.least < width else 0
            while at > 0:  # whole shorter items among the suffixes
                for n, name in self.short[at] or ():
                    if n <= size:
                        yield i + 1 - n, i + 1, {name}
                at = link[at]


def _scan(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    data, offsets = W.utf8(texts)
    return W.scan(data, offsets, W.ALPHANUMERIC, True), offsets


def _item_words(width: int, block_words: int):
    """Word hashes of the items; an item longer than a block in pieces that overlap by all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.resliced(batches, 2 << 20):
            words, _ = _scan(batch.column(1))
            names, pieces = [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                lo, end = int(words.first[i]), int(words.first[i + 1])
                while lo < end:
                    hi = min(end, lo + max(block_words, width))
                    names.append(name)
                    pieces.append(words.hash[lo:hi].view(np.int64))
                    lo = end if hi == end else hi - width + 1
            flat = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), W.lists(pa.array(flat), np.array([len(x) for x in pieces], np.int64))], ["item", "words"])

    return run


def _blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[list[tuple[str | None, list[int]]]]:
    """Items in blocks of about ``block_words`` words, dealt by hash; one block at a time is brought to the driver."""
    items = written(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_words(width, block_words), "item string, words array<bigint>"))
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_words))
    for number in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == number).collect()
        yield [(r["item"], np.array(r["words"], np.int64).view(np.uint64).tolist()) for r in rows]


def _grams(hashes: np.ndarray, counts: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(counts)])
    return W.windows(W.Words(hashes, hashes, hashes, first), q)


def _pass(shared):
    """Add the matches of one block of items to the columns that the passes carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, grams = shared.value
        kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "end", "from_byte", "to_byte")]))
        for batch in W.resliced(batches, 2 << 20):
            words, offsets = _scan(batch.column(1))
            at, hashes = W.windows(words, machine.q)
            where = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
            at = at[grams[where] == hashes]
            row = words.row
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            spans, items = [x or [] for x in spans], [set(x or []) for x in items]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(at)) - 1 if len(start) else start
            for lo, hi in zip(at[start].tolist(), (at[stop] + machine.q).tolist(), strict=True):
                if hi - lo < machine.least:
                    continue
                r = int(row[lo])
                covered = np.zeros(hi - lo, bool)
                for a, b, names in machine.stream(words.hash[lo:hi].tolist()):
                    covered[a:b] = True
                    items[r] |= {x for x in names if x is not None}
                edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
                base, byte = int(words.first[r]), int(offsets[r])
                for a, b in zip(np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo, strict=True):
                    spans[r].append({"first": int(a) - base, "end": int(b) - base, "from_byte": int(words.start[a]) - byte, "to_byte": int(words.end[b - 1]) - byte})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_merged(x) for x in spans], kind), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(words.count.astype(np.int64))], ["row", "text", "spans", "items", "n_words"])

    return run


def _merged(spans: list[dict]) -> list[dict]:
    """Overlapping or touching spans joined."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["end"]:
            if s["end"] > out[-1]["end"]:
                out[-1] |= {"end": s["end"], "to_byte": s["to_byte"]}
        else:
            out.append(dict(s))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words of ``docs`` inside any window of ``width`` consecutive words of a test item.

    Both tables have ``text``; items have ``item_id``.  Words are runs of
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; an item of fewer
    than ``width`` words, but not none, is one window.  Returns the columns
    ``row`` (a struct of the input row, whatever its columns are called),
    ``text``, ``spans`` (merged word and byte ranges that are hit), ``items`` (ids
    as strings, sorted) and ``n_words``.

    Defined cases: null or empty text has no words and no hits; repeated rows are
    judged alike; items that repeat an id count once; an item without an id still
    marks words but is not listed; without items nothing is hit; very long texts are
    read whole, and an item longer than a block goes in overlapping pieces.
    """
    spark = docs.sparkSession
    text_batches(docs)
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text")
    d = d.select("row", "text", F.expr("cast(null as array<struct<first:int,end:int,from_byte:int,to_byte:int>>)").alias("spans"), F.expr("cast(null as array<string>)").alias("items"), F.lit(0).cast("bigint").alias("n_words"))
    schema = f"row {d.schema['row'].dataType.simpleString()}, text string, {_FOUND}"
    for number, block in enumerate(_blocks(benchmark, width, block_words)):
        if number:
            d = written(d)  # one pass a stage: each keeps one automaton in a worker's memory
        machine = SuffixAutomaton(block, width)
        grams = np.unique(_grams(np.array([w for _, x in block for w in x], np.uint64), np.array([len(x) for _, x in block], np.int64), machine.q)[1])
        shared = spark.sparkContext.broadcast((machine, grams if len(grams) else np.zeros(1, np.uint64)))
        d = d.mapInArrow(_pass(shared), schema)
    return d


def _without(text: Column, spans: Column) -> Column:
    """The text without the bytes of its spans, which are in order."""
    raw, n = text.cast("binary"), F.size(spans)

    def piece(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["to_byte"])
        end = F.when(i == n, F.octet_length(text)).otherwise(F.get(spans, i)["from_byte"])
        return F.substr(raw, start + 1, end - start)

    rest = F.aggregate(F.sequence(F.lit(0), n), F.lit(b""), lambda done, i: F.concat(done, piece(i)))
    return F.when(n > 0, rest.cast("string")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, least_span: int = 10, most_coverage: float = 0.5) -> DataFrame:
    """``docs`` with leaked spans cut out; documents that are mostly test items go.

    Spans of at least ``least_span`` words, or whole shorter items, are removed
    from ``text``.  A row is dropped if the share of hit words exceeds
    ``most_coverage``.  Columns are those of ``docs``; nulls stay.
    """
    found = find_leaks(docs, benchmark, width)
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)")
    whole = F.col("n_words")
    kept = found.filter(hit <= whole * F.lit(most_coverage))
    long = F.filter("spans", lambda s: (s["end"] - s["first"] >= least_span) | (s["end"] - s["first"] < width))
    kept = kept.select("row", "text", long.alias("spans"))
    return kept.select(*((_without(F.col("text"), F.col("spans")) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)")
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH it AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), @), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), @), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM iw),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM win JOIN iw USING (n, k)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""".replace("@", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'")
