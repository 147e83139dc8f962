"""Token counts and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from weftgraph.llm import token_counts as C
from weftgraph.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
ODD = ["", "a", "<|endoftext|>", "don't 'stuff ''s 're've'll x'LL 'R", "ΣΑΣ Σ", "  ", "é́ é ́x", "İstanbul ½²³ 12a3", "日本語 テスト", "a b\u0085c", "x" * 3000, "'" * 600 + "s", "µÀß÷×", "<|startoftext|>abc<|ENDOFTEXT|>", "<|endoftext|> <|ENDOFTEXT|> A1 a1", "\x1c \x1f\x00a", "don’t…", "word. word, WORD!! a|b", "BB\x1c's©a<|startoftext|><|endoftext|>\x1c", "тест\x1d's\x1e日\x1f\x85本 <|endoftext|>'re", "\u1680\u200b\u2028a\u3000b\u00a0c\ufeff", "퟿\U0001f600 ok"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("abcdefgst'’ .,!é<|>ÀßZQ01 \n\t\x1c\x1f\x85тЖ日́Σ") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_counts_equal_the_library(library):
    some = texts(1, 1500)
    assert C.count_texts(some, PATH).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_in_the_library(text):
    assert C.count_texts([text], PATH)[0] == len(C._machine(PATH)[0].encode(text, add_special_tokens=False).ids)


def test_chunk_maps_compose_and_tables_restart(monkeypatch, library):
    monkeypatch.setattr(C, "CHUNK", 3)
    some = texts(2, 200)
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in some]
    assert C.count_texts(some, PATH).tolist() == expected
    monkeypatch.setattr(C, "TABLE_BYTES", 1 << 20)  # the library counts what no longer fits
    for lo in range(0, len(some), 20):
        assert C.count_texts(some[lo : lo + 20], PATH).tolist() == expected[lo : lo + 20]


def test_a_very_long_word_takes_linear_time(library):
    import time

    rng = random.Random(8)
    word = "é" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    C.count_texts([word[:1000]], PATH)
    began = time.process_time()
    got = C.count_texts([word, "x" * (1 << 20), "ok"], PATH)
    assert time.process_time() - began < 20
    assert got[2] == 1 and got[0] == len(library.encode(word, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["\x1c", "\x1f", "\x85", " ", "'s", "'", "Б", "б", "日", "a", "Z9", "<|endoftext|>", "<|", "é", "\u0301", "!", "½", "\u2028", "ǅ", "ß", "İ"]), max_size=12))
def test_spaces_and_scripts_count_as_in_the_library(parts):
    text = "".join(parts)
    assert C.count_texts([text], PATH)[0] == len(C._machine(PATH)[0].encode(text, add_special_tokens=False).ids)


def test_count_query_shape(spark, library):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (None, "é x"), (3, "w " * 3000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_bytes", F.lit("clash"))
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(docs, PATH).collect()))
    assert got == [("1", 11, 2, False), ("1", 11, 2, False), ("2", 0, 0, False), ("3", 6000, 3000, True), ("None", 4, 2, False)]
    assert C.count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.integers(0, 5))
def test_grammar_round_trip(ids, rounds):
    ids = np.array(ids, np.int64)
    seq, rules, spans = T.re_pair(ids, 5, rounds, least=2)
    assert T.expand(seq, rules, 5).tolist() == ids.tolist()
    assert [len(T.expand(np.array([5 + k]), rules, 5)) for k in range(len(rules))] == spans.tolist()


def test_grammar_has_no_pair_left_that_is_worth_a_rule():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 40000, 500)
    ids = np.concatenate([x for _ in range(300) for x in (passage, rng.integers(0, 40000, 3))] + [np.full(1000, 7)])
    for base, least in ((49000, 7), (65000, 4)):
        seq, rules, spans = T.smallest(ids, base)
        assert T.expand(seq, rules, base).tolist() == ids.tolist() and spans.max() >= 500
        pairs = {}
        for i, p in enumerate(zip(seq.tolist(), seq.tolist()[1:])):
            pairs.setdefault(p, []).append(i)
        assert max(len(x) for p, x in pairs.items() if p[0] != p[1]) < least and len(seq) < 300 * 5


def test_grammar_sorts_frequent_pairs_only(monkeypatch):
    """Pairs that wait for more frequent ones aren't sorted in every round."""
    rng = np.random.default_rng(6)
    often = [rng.integers(0, 200, 4) for _ in range(12)]
    rare = [rng.integers(1000, 40000, 20) for _ in range(400)]
    parts = [often[k] for k in range(12) for _ in range(10 * 2**k // 4 + 8)] + [x for x in rare for _ in range(8)]
    ids = np.concatenate([x for i in rng.permutation(len(parts)) for x in (parts[i], rng.integers(40000, 49000, 1))])
    taken, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda x, *a, **k: (taken.append(len(x)), sort(x, *a, **k))[1])
    seq, rules, spans = T.re_pair(ids, 49000)
    assert T.expand(seq, rules, 49000, spans).tolist() == ids.tolist()
    assert 0 < sum(taken) < 3 * len(ids)


def test_wide_symbols_only_where_smaller():
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.tile(rng.integers(0, 59000, 400), 5) for _ in range(60)] + [np.tile(np.arange(k, k + 1000), 8) for k in range(0, 59000, 1000)])
    seq, rules, _ = T.smallest(ids, 59000)
    assert T.expand(seq, rules, 59000).tolist() == ids.tolist()
    two = T.re_pair(ids, 59000)
    assert len(two[1]) == 65536 - 59000 and len(rules) > len(two[1]) and 4 * len(seq) + 12 * len(rules) < 2 * len(two[0]) + 12 * len(two[1])


def test_grammar_compresses_and_decodes_ranges():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 1000, 50)
    ids = np.concatenate([phrase if rng.random() < 0.7 else rng.integers(0, 1000, 20) for _ in range(400)])
    seq, rules, spans = T.re_pair(ids, 1000)
    assert len(seq) < len(ids) / 2
    row = {"symbols": seq.astype("<u2").tobytes(), "width": 2, "rules": rules.astype("<u4").tobytes(), "spans": spans.astype("<u4").tobytes(), "base": 1000}
    for first, end in ((0, 1), (17, 400), (len(ids) - 5, len(ids)), (100, 100)):
        assert T.decode_range(row, first, end).tolist() == ids[first:end].tolist()


def test_encoder_equals_the_library(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "REMEMBERED", 100)
    encoder = T._Encoder(PATH)
    some = texts(3, 600)
    for lo in range(0, len(some), 150):
        flat, sizes = encoder.encode(pa.array(some[lo : lo + 150]))
        expected = [library.encode(t, add_special_tokens=False).ids for t in some[lo : lo + 150]]
        assert sizes.tolist() == [len(x) for x in expected]
        assert flat.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("shard,part", [(1_000_000, 1 << 24), (40, 500)])
def test_files_round_trip(spark, tmp_path, library, shard, part):
    rng = random.Random(4)
    rows = [(rng.randrange(100), t) for t in texts(5, 80)] + [(7, None), (7, "same"), (7, "same"), (None, "no id")]
    folder = f"file://{tmp_path}/ids"
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("part", F.lit("clash"))
    T.write_token_files(docs, folder, PATH, shard_tokens=shard, bytes_per_part=part)
    got = [tuple(r) for r in T.read_token_files(spark, folder).orderBy("start").collect()]
    at, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert got == expected


def test_empty_files(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    T.write_token_files(spark.createDataFrame([], SCHEMA), folder, PATH)
    assert T.read_token_files(spark, folder).count() == 0
