"""Token-id output with Re-Pair grammar compression.

Documents are dealt by doc_id range, sorted, encoded, and written in shards of
about ``SHARD_TOKENS`` ids.  A shard is one row of a Parquet dataset, so any store
that Spark can write will do and a lost task leaves nothing behind:

``part, shard``   place in ascending doc_id order
``doc_ids, lengths``  documents and their ids' counts, end id included
``start``         ids before the shard within its part
``rules``         Re-Pair rules, little-endian uint32 pairs: rule k stands for id base + k
``spans``         expansion length of every rule, little-endian uint32
``width, symbols``  the compressed sequence, as little-endian uint16 or uint32

Re-Pair replaces the most frequent adjacent pairs of a shard by nonterminals,
many pairs a round, until no pair is worth a rule: a pair is replaced where it is
more frequent than its neighbours, so that replaced pairs never overlap.  With the expansion lengths a
range of ids is decoded without decoding what precedes it.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import shared_folder, tasks, text_batches

#: Ids in a shard, about: a worker's grammar tables take some 60 bytes an id.
SHARD_TOKENS = 1 << 19
#: Text bytes encoded at once.
PIECE = 1 << 19
#: Slots of the table that counts pairs.
SLOT_BITS = 18
#: A pair is worth a rule from this many occurrences in the shard: a rule takes 12 bytes, and each saves a symbol of 2 or 4 bytes.
LEAST_PAIRS = (7, 4)
#: Runs of characters whose ids a worker keeps before it starts afresh, and slots to find them in.
REMEMBERED = 1_000_000
SLOTS = 1 << 20
_SCHEMA = "part int, shard int, start bigint, base int, doc_ids array<bigint>, lengths array<int>, rules binary, spans binary, width int, symbols binary"


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def _pairs(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pairs that begin at ``at``, as one number each."""
    return seq[at].astype(np.int64) << 32 | seq[at + 1]


def _around(at: np.ndarray, offsets: tuple, n: int) -> np.ndarray:
    """Places below ``n`` that are so far from one of ``at``, each once."""
    marked = np.zeros(n + 2, bool)
    for k in offsets:
        marked[at + k] = True
    return np.flatnonzero(marked[:n])


def _counted(seq: np.ndarray, slots: np.ndarray, full: np.ndarray, floor: int) -> tuple[np.ndarray, ...]:
    """Places whose slot holds ``floor`` pairs or more, their pairs, these in order, where each kind starts, and the kinds' counts."""
    at = np.flatnonzero((full >= floor).take(slots))
    pair = _pairs(seq, at)
    # a run of one symbol has its pairs at every second place
    again = np.flatnonzero((pair[1:] == pair[:-1]) & (at[1:] == at[:-1] + 1)) + 1
    if len(again):
        first = np.concatenate([[True], again[1:] != again[:-1] + 1])
        offset = np.arange(len(again)) - np.maximum.accumulate(np.where(first, np.arange(len(again)), 0))
        pair[again[offset % 2 == 0]] = -1
    ordered = np.sort(pair)
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(at) else at
    counts = np.diff(np.append(start, len(ordered)))
    counts[ordered[start] < 0] = 0
    return at, pair, ordered, start, counts


def re_pair(ids: np.ndarray, base: int, rounds: int | None = None, least: int | None = None, most_rules: int | None = None, begun: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, expansion lengths) of a grammar for ``ids`` (all below ``base``).

    Goes on until no pair occurs ``least`` times, or for ``rounds``; ``begun`` is a grammar to go on from.
    """
    if most_rules is None:
        most_rules = 65536 - base if base < 60000 else 1 << 31
    if least is None:
        least = LEAST_PAIRS[base + most_rules > 65536]
    if begun is None:
        seq, rules, spans = ids.astype(np.int32), np.empty((0, 2), np.int64), np.ones(base, np.int64)
    else:
        seq, rules, spans = begun[0].astype(np.int32), begun[1], np.concatenate([np.ones(base, np.int64), begun[2]])
    slots = _slot(seq[:-1].astype(np.int64) << 32 | seq[1:]).astype(np.int32)
    full = np.bincount(slots, minlength=1 << SLOT_BITS)
    done = 0
    while (rounds is None or done < rounds) and len(seq) > 1 and len(rules) < most_rules:
        done += 1
        # a slot of the hash table holds at least its pairs' counts: where it has too few, none of them is frequent
        floor = max(least, int(full.max()) // 5)
        at, pair, ordered, start, counts = _counted(seq, slots, full, floor)
        # the most frequent first: the others wait until these are replaced
        if (lower := max(least, int(counts.max(initial=0)) // 4)) < floor:
            at, pair, ordered, start, counts = _counted(seq, slots, full, lower)
        worth = np.flatnonzero(counts >= max(least, int(counts.max(initial=0)) // 4))
        kinds, counts = ordered[start[worth]], counts[worth]
        # equal counts in an order that doesn't rise along a passage
        kinds = kinds[np.lexsort((W.mix(kinds.view(np.uint64)), -counts))[: most_rules - len(rules)]]
        if not len(kinds):
            break
        slot = slots[at]
        table = np.zeros(1 << SLOT_BITS, np.int32)
        own = _slot(kinds)
        table[own] = np.arange(len(kinds))
        where = table[slot]
        hit = kinds[where] == pair
        lost = np.flatnonzero(table[own] != np.arange(len(kinds)))
        if len(lost):  # kinds that share their slot with another are looked up in order
            lost = lost[np.argsort(kinds[lost])]
            table[:] = 0
            table[own[lost]] = 1
            left = np.flatnonzero(~hit & (table[slot] > 0))
            found = np.minimum(np.searchsorted(kinds[lost], pair[left]), len(lost) - 1)
            same = kinds[lost[found]] == pair[left]
            where[left[same]] = lost[found[same]]
            hit[left[same]] = True
        at, which = at[hit], where[hit]
        # no two neighbours have one rank, so what is replaced never overlaps, and the first kind is replaced everywhere
        touch, earlier = at[1:] == at[:-1] + 1, which[1:] < which[:-1]
        keep = np.ones(len(at), bool)
        keep[1:] &= ~touch | earlier
        keep[:-1] &= ~touch | (which[:-1] < which[1:])
        at, which = at[keep], which[keep]
        enough = np.bincount(which, minlength=len(kinds)) >= least
        used = np.flatnonzero(enough)
        if not len(used):
            break
        at, which = at[enough[which]], which[enough[which]]
        made = np.stack([kinds[used] >> 32, kinds[used] & 0xFFFFFFFF], 1)
        seq[at] = base + len(rules) + (np.cumsum(enough) - 1)[which]
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        # the pairs that reach into what is replaced leave the table, and those of the new symbols enter it
        np.subtract.at(full, slots[_around(at, (-1, 0, 1), len(slots))], 1)
        seq, slots = seq[kept], slots[kept[1:]]
        new = _around(at - np.arange(len(at)), (-1, 0), len(slots))
        slots[new] = _slot(_pairs(seq, new))
        np.add.at(full, slots[new], 1)
        spans = np.concatenate([spans, spans[made].sum(1)])
        rules = np.concatenate([rules, made])
    return seq.astype(np.int64), rules, spans[base:]


def smallest(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grammar with symbols of 2 bytes, or if these run out before the pairs do, of 4 bytes where that is smaller."""
    found = re_pair(ids, base)
    if base >= 60000 or base + len(found[1]) < 65536:
        return found
    wide = re_pair(ids, base, most_rules=1 << 31, begun=found)
    return min(found, wide, key=lambda g: len(g[0]) * (2 if g is found else 4) + len(g[1]) * 12)


def _spread(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Expand all symbols level by level."""
    while len(rules) and (seq >= base).any():
        double = seq >= base
        at = np.cumsum(1 + double) - 1 - double
        out = np.empty(len(seq) + int(double.sum()), np.int64)
        out[at[~double]] = seq[~double]
        two = rules[seq[double] - base]
        out[at[double]] = two[:, 0]
        out[at[double] + 1] = two[:, 1]
        seq = out
    return seq


def expand(seq: np.ndarray, rules: np.ndarray, base: int, spans: np.ndarray | None = None) -> np.ndarray:
    """The ids that a sequence of symbols stands for; with the rules' lengths each rule is expanded once."""
    seq = seq.astype(np.int64)
    if spans is None or len(rules) >= len(seq):
        return _spread(seq, rules, base)
    flat = np.concatenate([np.arange(base), _spread(base + np.arange(len(rules)), rules, base)])
    rule = seq >= base
    size, start = np.ones(len(seq), np.int64), seq.copy()
    which = seq[rule] - base
    size[rule], start[rule] = spans[which], base + (np.cumsum(spans) - spans)[which]
    to = np.cumsum(size)
    return flat[np.repeat(start - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)]


def _symbols(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seq = np.frombuffer(row["symbols"], "<u2" if row["width"] == 2 else "<u4").astype(np.int64)
    return seq, np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2), np.frombuffer(row["spans"], "<u4").astype(np.int64)


def decode_range(row: dict, first: int, end: int) -> np.ndarray:
    """Ids ``first`` to ``end`` of a shard, decoding only the symbols that reach into them."""
    seq, rules, spans = _symbols(row)
    size = np.where(seq >= row["base"], spans[np.maximum(seq - row["base"], 0)] if len(spans) else 1, 1)
    to = np.cumsum(size)
    lo, hi = int(np.searchsorted(to, first, "right")), int(np.searchsorted(to, end, "left")) + 1
    before = int(to[lo - 1]) if lo else 0
    return expand(seq[lo:hi], rules, row["base"], spans)[first - before : end - before]


_SPACE, _LETTER, _MARK, _ODD = 0, 1, 2, 3


def _kinds() -> np.ndarray:
    """Byte kinds: white space, letters (ASCII, and bytes that may be of U+00C0 to U+00FF), plain marks, others."""
    kinds = np.full(256, _ODD, np.uint8)
    kinds[~W.NOT_SPACE] = _SPACE
    kinds[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 0xC3, *range(0x80, 0xC0)]] = _LETTER
    kinds[[*b".,;:!?|#*$%&"]] = _MARK
    return kinds


_KIND = _kinds()


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray]:
    """Runs that are encoded each by itself: letters, marks, or a whole white-space-delimited word.

    A word is split into letters and marks if it has nothing else; then each run
    is one pre-token of the vocabulary.  Other words stay whole, and are marked in
    the second array.  The hashes of letters fold their case, on which the ids don't
    depend.
    """
    kind = _KIND[data]
    if len(data):
        # a byte of a two-byte letter counts only as part of a pair C3 80..BF other than the signs 97 and B7
        lead, tail = data == 0xC3, (data >= 0x80) & (data < 0xC0)
        after_lead = np.concatenate([[False], lead[:-1]])
        before_tail = np.concatenate([tail[1:], [False]])
        kind[(lead & ~before_tail) | (tail & ~after_lead) | (after_lead & ((data == 0x97) | (data == 0xB7)))] = _ODD
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            edge = kind == _SPACE
            edge = np.concatenate([[True], edge])
            edge[offsets[:-1]] |= True
            cut = np.flatnonzero(edge)  # a word begins here or one byte later
            word = np.unique(np.searchsorted(cut, odd, "right") - 1)
            lo, hi = cut[word], np.append(cut, len(data))[word + 1]
            mark = np.zeros(len(data) + 1, np.int8)
            np.add.at(mark, lo, 1)
            np.add.at(mark, hi, -1)
            inside = np.cumsum(mark[:-1]) > 0
            kind[inside & (kind != _SPACE)] = _ODD
    small = np.where((kind == _LETTER) & (data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    found = W.runs(small, offsets, kind, False)
    return found, kind[found.start] == _ODD


class _Encoder:
    """Ids of texts, run by run (see pre_tokens), with a memory of runs in a table of two slots each.

    White space is dropped by this kind of vocabulary, so the ids of a text are
    those of its runs in turn.  Runs that are not remembered are encoded many at
    a time in one text: letters or marks have one token with the word-end suffix,
    which tells them apart again; other words are encoded one by one.  Runs are
    told apart by 64-bit hashes, equal for different ones with probability 2**-64
    a pair.
    """

    def __init__(self, path: str):
        # one task has one core: the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size()
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.base, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.keys, self.place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.forget()

    def forget(self) -> None:
        self.keys[:] = 0
        self.flat, self.first, self.runs = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def _learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = int(self.first[self.runs]), self.runs
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(sizes) >= len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
        self.flat[at : at + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.runs += len(sizes)

    def _encode_new(self, raw: bytes, words: W.Words, which: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Encode the runs ``which`` of the batch; their places."""
        base = self.runs
        plain, whole = which[~odd[which]], which[odd[which]]
        for lo in range(0, len(plain), 10_000):
            some = plain[lo : lo + 10_000]
            text = b" ".join([raw[a:b] for a, b in zip(words.start[some].tolist(), words.end[some].tolist(), strict=True)]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            self._learn(ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        if len(whole):
            texts = [raw[a:b].decode() for a, b in zip(words.start[whole].tolist(), words.end[whole].tolist(), strict=True)]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._learn(np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each]))
        place = np.empty(len(which), np.int64)
        place[~odd[which]] = base + np.arange(len(plain))
        place[odd[which]] = base + len(plain) + np.arange(len(whole))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        data, offsets = W.utf8(texts)
        words, odd = pre_tokens(data, offsets)
        if self.runs > REMEMBERED:
            self.forget()
        slot = (words.hash & np.uint64(SLOTS - 1)).astype(np.int64)
        run = self.place[slot].astype(np.int64)
        missed = np.flatnonzero(self.keys[slot] != words.hash)
        if len(missed):  # a run is in one of two slots
            other = (words.hash[missed] >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)
            found = self.keys[other] == words.hash[missed]
            run[missed[found]] = self.place[other[found]]
            missed, other = missed[~found], other[~found]
        if len(missed):
            _, at, back = np.unique(words.hash[missed], return_index=True, return_inverse=True)
            new = missed[at]
            place = self._encode_new(data.tobytes(), words, new, odd)
            run[missed] = place[back]
            to = np.where(self.keys[slot[new]] == 0, slot[new], other[at])
            self.keys[to], self.place[to] = words.hash[new], place
        size = self.first[run + 1] - self.first[run]
        to = np.cumsum(size)
        at = np.repeat(self.first[run] - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)
        per_text = np.concatenate([[0], to])[words.first]
        return self.flat[at], np.diff(per_text)


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids, tokens, lengths, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            seq, rules, spans = smallest(np.concatenate(tokens), encoder.base)
            width = 2 if encoder.base + len(rules) <= 65536 else 4
            row = {"part": part, "shard": shard, "start": start, "base": encoder.base, "doc_ids": np.concatenate(ids), "lengths": np.concatenate(lengths).astype(np.int32), "rules": rules.astype("<u4").tobytes(), "spans": spans.astype("<u4").tobytes(), "width": width, "symbols": seq.astype(f"<u{width}").tobytes()}
            kinds = {"part": pa.int32(), "shard": pa.int32(), "start": pa.int64(), "base": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "rules": pa.binary(), "spans": pa.binary(), "width": pa.int32(), "symbols": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], [*kinds])

        for batch in W.resliced(batches, PIECE):
            flat, sizes = encoder.encode(batch.column(1))
            n = len(sizes)
            out = np.full(len(flat) + n, end_id, np.int32)
            out[np.arange(len(flat)) + np.repeat(np.arange(n), sizes)] = flat
            ids.append(np.array(batch.column(0).to_pylist(), object) if batch.column(0).null_count else batch.column(0).to_numpy())
            tokens.append(out)
            lengths.append(sizes + 1)
            held += len(out)
            if held >= shard_tokens:
                yield close()
                shard, start = shard + 1, start + held
                ids, tokens, lengths, held = [], [], [], 0
        if ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, bytes_per_part: int = 16 << 20) -> None:
    """Encode every whole text and write the ids to ``folder``, in ascending doc_id order.

    ``path`` is a file of the tokenizers library whose vocabulary drops white
    space.  Null text counts as empty; each document ends with ``end_id``; rows
    that repeat a doc_id are ordered by text; null ids come first; other columns
    are ignored; an empty table gives an empty dataset.
    """
    text_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    dealt = docs.repartitionByRange(tasks(int(-(-total // bytes_per_part))), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_write(path, end_id, shard_tokens), _SCHEMA).write.parquet(folder)


def read_shards(spark, folder: str) -> DataFrame:
    """The shards, with ``start`` counted from the first document of all.

    One row per written part (16 MB of text, more beyond ``MOST_TASKS`` parts) meets in the window; shards within a
    part were counted as they were written.
    """
    shards = spark.read.schema(_SCHEMA).parquet(folder)
    ends = shards.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda n, x: n + x)).alias("n"))
    before = ends.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    return shards.join(before, "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one shard at a time
                doc_ids, lengths = batch.column("doc_ids")[i].values, batch.column("lengths")[i].values.to_numpy().astype(np.int64)
                row = {k: batch.column(k)[i].as_py() for k in ("start", "base", "rules", "spans", "width", "symbols")}
                seq, rules, spans = _symbols(row)
                ids = expand(seq, rules, row["base"], spans).astype("<u4")
                to = np.cumsum(lengths)
                at = to - lengths
                columns = {
                    "doc_id": doc_ids,
                    "start": pa.array(at + row["start"]),
                    "n_tokens": pa.array(to - at),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = W.lists(pa.array(ids.astype(np.int32)), to - at)
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return run


def read_token_files(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents decoded from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids``."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    shards = read_shards(spark, folder)
    text_batches(shards)
    return shards.mapInArrow(_read(with_ids), schema)


def op6_token_id_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, with_ids=False)
