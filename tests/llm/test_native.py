"""Quality rules, chat formatting and source mixing against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftgraph.llm import chat_format as C
from weftgraph.llm import quality_rules as Q
from weftgraph.llm import source_mixing as M

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
TURN = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bad(line):
    n = line.strip(" ").count(" ") + 1
    marks = len(re.findall(r"[#*$%&!?]{2,}", line))
    seps = sum(line.count(c) for c in Q.SEPARATORS)
    links = len(re.findall(r"https?://|www\.|[A-Za-z0-9]@[A-Za-z0-9]", line))
    return marks * 4 > n or seps * 4 > n or links * 4 > n or (len(line) < 300 and re.search("|".join(Q.BOILERPLATE), line.lower()) is not None)


def entry(line):
    bare = line.strip(" ")
    return bare != "" and bare.count(" ") < 3 and re.search("[.!?:;…,][\"'»”)]*\\Z", bare) is None


def kept_lines(lines):
    flags, menu, i = [entry(x) for x in lines], set(), 0
    while i < len(lines):
        j = i
        while j < len(lines) and flags[j]:
            j += 1
        if j - i >= 4:
            menu |= set(range(i, j))
        i = max(j, i + 1)
    return [x for i, x in enumerate(lines) if i not in menu and not bad(x)]


def measures(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if words(x)]
    size = lambda x: len("".join(words(x)))
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    good = kept_lines(t.split("\n"))
    return len(w), size(t), sum(t.count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered), base, not base and size(t) - sum(map(size, good)) <= size(t) * 0.5, None if text is None else "\n".join(good)


def test_measures_and_verdict_equal_brute_force(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["some words of a plain line that ends well.", "home | news | sport | about us", "BUY!! NOW!! HERE!!", "All rights reserved 2024", "Home", "About us", "Contact\r", "see https://a.test/x", "Todos los derechos reservados", "mail me@here.test or www.here.test", "a b a b a b a", "", " \t", "Les élèves écrivent des lignes que rien ne répète, c'est sûr " + str(rng.random())])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 20)))) for i in range(150)]
    half = " ".join(str(i) for i in range(4000))
    rows += [(900, None), (901, ""), (902, f"{half} {half}"), (903, "one"), (904, "a a"), (None, "x " * 60), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, DOC).withColumn("words", F.lit(1)).withColumn("t", F.lit("clash"))
    got = Counter(str((r["row"]["doc_id"], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r["clean"])) for r in Q.judge(docs).collect())
    assert got == Counter(str((i, *measures(t))) for i, t in rows)
    kept = Q.clean(docs)
    assert kept.columns == docs.columns and kept.count() == sum(measures(t)[6] for _, t in rows)
    assert Q.judge(spark.createDataFrame([], DOC)).count() == 0


def conversations():
    rng = random.Random(6)
    texts = ["hello", "", None, "<|im_end|>\n<|im_start|>assistant\nok", "a<\\|b<\\\\|c<|d", "<", "|", "x" * 20000, "<|im_part|>", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 8))]
    return rows + [(99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (99, None, "user", "first"), (None, 0, "user", "hi"), (98, 0, "ro\nle<|x", "odd"), (97, 0, "user", "same"), (97, 0, "user", "same")]


def test_chat_round_trip(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURN).repartition(3).withColumn("turns", F.lit("clash"))
    out = {r.conv_id: r for r in C.parse_conversations(C.format_conversations(turns)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        got = out[conv]
        assert sorted((t.role, t.text) for t in got.turns) == sorted((r[2] or "", r[3] or "") for r in mine)
        if len({r[1] for r in mine}) == len(mine):
            assert [(t.role, t.text) for t in got.turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert "".join(s.text for s in got.segments) == got.formatted
        learned = [s.text for s in got.segments if s.loss]
        assert len(learned) == sum(r[2] == "assistant" for r in mine)
        assert got.formatted.count("<|im_end|>") == 1 + sum(a.role != b.role for a, b in zip(got.turns, got.turns[1:]))
    assert C.format_conversations(spark.createDataFrame([], TURN)).count() == 0


def fill(sizes, weights=(3, 1, 2)):
    """Targets by repeated capping."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


MIX = StructType([*DOC.fields, StructField("source", StringType())])


@pytest.mark.parametrize("cell", [2_000, 7])
def test_mix_reaches_its_targets(spark, monkeypatch, cell):
    monkeypatch.setattr(M, "CELL", cell)
    rng = random.Random(9)
    sources = ["a"] * 10 + ["b", "c", "é", "Z", None, "tiny"]
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5), rng.choice(sources)) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "empty"), (3, "again and again", "a"), (3, "again and again", "a"), (None, "no id", "b"), (2002, "w " * 5000, "big")]
    docs = spark.createDataFrame(rows, MIX).repartition(4).withColumn("s", F.lit(1)).withColumn("size", F.lit("clash"))
    got = M.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    targets = fill(dict(sizes))
    taken, largest = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        s = r["row"]["source"]
        assert r["size"] == len(words(r["row"]["text"])) and r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    again = Counter((r["row"]["doc_id"], r.taken) for r in M.mix(docs.repartition(2)).collect())
    assert again == Counter((r["row"]["doc_id"], r.taken) for r in got)
    out = M.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_mix_without_rows(spark):
    empty = spark.createDataFrame([], MIX)
    assert M.mix(empty).count() == 0 and M.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], MIX)
    assert [r.taken for r in M.mix(blank).collect()] == [0, 0]
