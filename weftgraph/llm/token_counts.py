"""Token counts by a compiled finite-state tokenizer.

The BPE vocabulary is compiled to a deterministic transducer whose transitions
carry the number of tokens they emit.

* **Why it is finite.**  The BPE encoding of a string without its last token is
  the encoding of the shorter string, and the last token is the one that forms a
  valid pair with the token before it.  So the only memory that a prefix needs
  is, for each earlier boundary whose suffix still starts some token: the trie
  node of that suffix, the token before the boundary and how many tokens fewer
  there were.  That tuple is the state; a transition emits the change in the
  token count (zero, positive or negative), and the sum over a word telescopes
  to its number of tokens.
* **Compilation** is lazy: transitions are derived from the vocabulary and the
  merges when a text first takes them, and kept in dense tables.
* **Chunks.**  A batch is cut into equal chunks that all step together.  Each
  chunk's map is constant after its first word end (every word end resets the
  state), so it is held as (symbols before the first reset, end state after it);
  maps compose from left to right, which fixes every chunk's incoming state.  A
  prefix sum over the emissions then gives the counts of all documents.

The transducer reads the UTF-8 bytes of lower-cased words.  White space, letters,
numbers and lower case are what the tokenizer says they are: it is asked about a
code point when that first occurs.  An added token's string is one token and
ends words.  The library itself counts only texts that its normalisation changes
by more than lower case and white space (other than NFC, or a code point whose
lower case is longer), and batches of words so odd that the tables outgrow
``TABLE_BYTES``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import text_batches

#: Size at which the tables start afresh, and pairs of tokens remembered; both bound a worker's memory.
TABLE_BYTES = 48 << 20
MOST_PAIRS = 200_000
CHUNK = 256
#: Chunks up to which stepping one by one is faster than in arrays.
FEW = 4
_SPACE, _LETTER, _NUMBER, _OTHER, _STRANGE = range(5)


def _byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level BPE vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Alphabet:
    """Class and lower case of every code point, asked of the tokenizer when it first occurs."""

    def __init__(self, tokenizer):
        self.normalizer, self.pre = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.kind = np.full(sys.maxunicode + 1, -1, np.int8)
        self.lower = np.zeros(sys.maxunicode + 1, np.int32)

    def classes(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.kind[points] < 0])
        for c in new.tolist():
            self.kind[c], self.lower[c] = self._ask(chr(c))
        return self.kind[points]

    def _ask(self, c: str) -> tuple[int, int]:
        norm = self.normalizer.normalize_str(c)
        if len(norm) != 1 or unicodedata.category(c) == "Cn":
            return _STRANGE, 0
        one = lambda text: len(self.pre.pre_tokenize_str(text))
        kind = _SPACE if not one(norm) else _LETTER if one(f"a{norm}a") == 1 else _OTHER if one(f"!{norm}!") == 1 else _NUMBER
        return kind, ord(norm)


class TablesFull(Exception):
    """The transducer's tables have outgrown TABLE_BYTES."""


class Transducer:
    """Lazily compiled counting transducer of a BPE vocabulary with word-end symbols."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.suffix, self.bytes = suffix, _byte_symbols()
        self.trie: dict[tuple[int, str], int] = {}
        self.token_at: dict[int, tuple] = {}
        self.inner: set[int] = set()
        for token in vocabulary:
            end = token.endswith(suffix) and len(token) > len(suffix)
            letters = list(token[: -len(suffix)] if end else token)
            if end:
                letters[-1] += suffix
            node = 0
            for x in letters:
                self.inner.add(node)
                node = self.trie.setdefault((node, x), len(self.trie) + 1)
            self.token_at[node] = tuple(letters)
        self.valid: dict[tuple, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.tuples: list[tuple] = []
        self.column = np.full(512, -1, np.int32)
        self.width = 64
        self.codes = 0
        self.next = np.full((1024, self.width), -1, np.int32)
        self.emit = np.zeros((1024, self.width), np.int8)
        self._state(((0, None, 0),))

    def _state(self, x: tuple) -> int:
        if x not in self.states:
            self.states[x] = len(self.tuples)
            self.tuples.append(x)
            if len(self.tuples) > len(self.next):
                if 2 * (self.next.nbytes + self.emit.nbytes) > TABLE_BYTES:
                    raise TablesFull
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return self.states[x]

    def _merged(self, letters: tuple) -> list[str]:
        parts = list(letters)
        while len(parts) > 1:
            ranked = [(self.rank.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            least, i = min(ranked)
            if least == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, before: tuple | None, token: tuple) -> bool:
        key = (before, token)
        if key not in self.valid:
            if len(self.valid) > MOST_PAIRS:
                self.valid.clear()
            want = ["".join(token)] if before is None else ["".join(before), "".join(token)]
            self.valid[key] = self._merged((before or ()) + token) == want
        return self.valid[key]

    def _step(self, state: tuple, symbol: str) -> tuple[tuple, int]:
        """The next state tuple and the tokens emitted."""
        moved = [(child, before, rel) for node, before, rel in state if (child := self.trie.get((node, symbol)))]
        for child, before, rel in moved:  # boundaries in ascending order: the longest token first
            token = self.token_at.get(child)
            if token is not None and self._fits(None, token) and (before is None or self._fits(before, token)):
                emitted = rel + 1
                break
        else:
            raise ValueError(f"no token of the vocabulary ends with {symbol!r}")
        kept = [(c, b, r - emitted) for c, b, r in moved if c in self.inner]
        return (*kept, (0, token, 0)), emitted

    def _compile(self, state: int, code: int) -> None:
        """Derive one transition.  code: a byte, plus 256 at a word's end."""
        byte, last = code & 255, code >> 8
        now, emitted = self._step(self.tuples[state], self.bytes[byte] + (self.suffix if last else ""))
        to = 0 if last else self._state(now)
        self.next[state, self.column[code]] = to
        self.emit[state, self.column[code]] = emitted

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """Table columns of the codes; new codes get new columns."""
        for code in np.flatnonzero(np.bincount(codes, minlength=512)).tolist():
            if self.column[code] < 0:
                if self.codes == self.width and 2 * (self.next.nbytes + self.emit.nbytes) > TABLE_BYTES:
                    raise TablesFull
                self.column[code] = self.codes
                self.codes += 1
                if self.codes > self.width:
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                    self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)], axis=1)
                    self.width *= 2
        return self.column[codes].astype(np.int32)

    def advance(self, state: np.ndarray, column: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.next[state, column]
        unknown = np.flatnonzero(to < 0)
        if len(unknown):
            for key in np.unique(state[unknown].astype(np.int64) << 9 | code[unknown].astype(np.int64)).tolist():
                self._compile(key >> 9, key & 511)
            to = self.next[state, column]
        return to, self.emit[state, column]

    def walk(self, state: int, columns: list[int], codes: list[int]) -> tuple[int, list[int]]:
        """One chunk, step by step: the state after it and the tokens emitted at each step."""
        out = []
        for column, code in zip(columns, codes, strict=True):
            to = self.next.item(state, column)
            if to < 0:
                self._compile(state, code)
                to = self.next.item(state, column)
            out.append(self.emit.item(state, column))
            state = to
        return state, out


def word_ends(kind: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether a pre-token ends with each code point, from its class and its lower case.

    Fixed pattern: 's|'t|'re|'ve|'m|'ll|'d|[letters]+|[number]|[others]+ .
    """
    n = len(kind)
    after = np.zeros(n, np.int8)
    after[:-1] = kind[1:]
    end = (kind != _SPACE) & ((kind != after) | (kind == _NUMBER))
    quote = np.flatnonzero((lower == 0x27) & np.concatenate([[True], kind[:-1] != _OTHER]))
    if len(quote):
        padded = np.concatenate([lower, np.zeros(3, lower.dtype)])
        x, y = padded[quote + 1], padded[quote + 2]
        one = np.isin(x, [*b"stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for which, length in ((one, 1), (two & ~one, 2)):
            at = quote[which]
            end[at] = False
            if length == 2:
                end[at + 1] = False
            end[at + length] = True
    return end


def emissions(machine: Transducer, code: np.ndarray) -> np.ndarray:
    """Tokens emitted at each byte of the words (signed; prefix sums at word ends are exact).

    ``code`` is a byte, plus 256 where it is the last of a word; white space is left out.
    """
    column = machine.columns(code)
    emitted = np.zeros(len(code), np.int8)
    resets = np.flatnonzero(code >> 8)
    lo = np.arange(0, len(code), CHUNK)
    hi = np.minimum(lo + CHUNK, len(code))
    first = np.searchsorted(resets, lo)
    body = np.where(first < len(resets), resets[np.minimum(first, len(resets) - 1)] + 1, len(code)) if len(resets) else np.full(len(lo), len(code))
    closed = body <= hi  # chunks whose map is constant
    body = np.where(closed, body, hi)

    def run(which: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Step the chunks from start to stop together; their end states."""
        state = state.copy()
        if len(state) <= FEW:
            for j in range(len(state)):
                a, b = int(start[j]), int(stop[j])
                state[j], emitted[a:b] = machine.walk(int(state[j]), column[a:b].tolist(), code[a:b].tolist())
            return state
        order = np.argsort(start - stop, kind="stable")  # the longest first, so the active ones are a prefix
        length = (stop - start)[order]
        s, p = state[order], start[order].copy()
        live = len(order)
        for k in range(int(length.max(initial=0))):
            while live and length[live - 1] <= k:
                live = int(np.searchsorted(-length, -k, "left"))
            i = p[:live] + k
            s[:live], emitted[i] = machine.advance(s[:live], column[i], code[i])
        state[order] = s
        return state

    chunks = np.arange(len(lo))
    leaves = run(chunks, body, hi, np.zeros(len(lo), np.int64))
    enters = np.zeros(len(lo), np.int64)
    known = np.zeros(len(lo), bool)
    known[0] = True
    known[1:] = closed[:-1]
    enters[1:] = np.where(closed[:-1], leaves[:-1], 0)
    todo = known.copy()
    while todo.any():  # compose the maps; more than one round only where a word spans whole chunks
        i = np.flatnonzero(todo)
        out_state = run(i, lo[i], body[i], enters[i])
        passed = i[~closed[i]]
        leaves[passed] = out_state[~closed[i]]
        onward = passed[passed + 1 < len(lo)]
        enters[onward + 1] = leaves[onward]
        todo[:] = False
        todo[onward + 1] = True
    return emitted


@lru_cache(maxsize=2)
def _machine(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    special = [t["content"] for t in spec["added_tokens"]]
    added = set(special)
    machine = Transducer({k: v for k, v in model["vocab"].items() if k not in added}, model["merges"], model["end_of_word_suffix"])
    return tokenizer, machine, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)"), Alphabet(tokenizer)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    tokenizer, machine, special, alphabet = _machine(path)
    counts = np.zeros(len(texts), np.int64)
    plain = []
    for i, text in enumerate(texts):
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            counts[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
            text = ""
        elif "<" in text:
            text, found = special.subn(" ", text)
            counts[i] = found
        plain.append(text)
    points = np.frombuffer(" ".join(plain).encode("utf-32-le"), np.uint32).astype(np.int32)
    to = np.cumsum([len(t) + 1 for t in plain])
    kind = alphabet.classes(points)
    if (kind == _STRANGE).any():
        for i in np.unique(np.searchsorted(to, np.flatnonzero(kind == _STRANGE), "right")).tolist():
            counts[i] = len(tokenizer.encode(texts[i], add_special_tokens=False).ids)
            kind[to[i] - len(plain[i]) - 1 : to[i] - 1] = _SPACE
    lower = alphabet.lower[points]
    end = word_ends(kind, lower)
    at = np.flatnonzero(kind != _SPACE)  # white space neither emits nor keeps state: words end before it
    if not len(at):
        return counts
    lower = lower[at]
    last = np.cumsum(1 + (lower >= 0x80) + (lower >= 0x800) + (lower >= 0x10000))  # bytes up to each code point
    code = np.frombuffer(lower.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int16)
    code[last[end[at]] - 1] |= 256
    try:
        emitted = emissions(machine, code)
    except TablesFull:
        machine.clear()
        return np.array([len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], np.int64)
    total = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])[np.concatenate([[0], last])]
    return counts + np.diff(total[np.searchsorted(at, np.concatenate([[0], to]))])


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.resliced(batches, 2 << 20):
            _, offsets = W.utf8(batch.column(1))
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(count_texts(texts, path))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` is a byte-level BPE file of the tokenizers library with a word-end
    suffix.  Input: ``doc_id`` and ``text``; other columns are ignored.  Nulls
    in ``text`` count as the empty text (no bytes, no tokens); repeated rows and
    null ids each keep a row; an empty table gives no rows; a very long text is counted
    whole, in time proportional to its length.  No shuffle.
    """
    text_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    counted = docs.mapInArrow(_count(path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
