"""Quality rules: line-first cleaning with Spark expressions only.

Every line is judged by itself (punctuation, navigation, links, boilerplate) or with
the lines around it (menus); failing lines are removed; then a document goes if it fails the base rules or has lost
too much of its text.  Everything happens within the row with array functions:
no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\f\r"
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
#: Separators between the items of a navigation line.
SEPARATORS = "|»›•·"
#: Phrases of lines that say nothing about the page's subject.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of (use|service)",
    "accept (all )?cookies",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "skip to (main )?content",
    "^licen[sc]ed under",
    "^copyright",
    "spdx-license-identifier",
    "released under the [a-z0-9. -]+ licen[sc]e",
    "(is|are) licen[sc]ed under",
    "(share|follow us) on (facebook|twitter|instagram|linkedin)",
    "click here",
    "sign up (now|today|for)",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "cookies akzeptieren",
    "tous droits réservés",
    "politique de confidentialité",
    "accepter les cookies",
    "todos los derechos reservados",
    "política de privacidad",
    "aceptar (las )?cookies",
)
#: Lines of a menu: this many or more, one below the other, of at most so many words without an end of sentence.
MENU_LINES, MENU_WORDS = 4, 3


def _let(value: Column, body) -> Column:
    """body(x) with x bound to value, so that lambdas don't evaluate it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _drop(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(_drop(text, chars))


def failing(line: Column) -> Column:
    """Whether a line fails one of the rules.

    * punctuation: over a quarter of its words carry a run of two or more marks;
    * navigation: it has over one separator to four words;
    * links: it has over one address (URL or e-mail) to four words;
    * boilerplate: it is short and holds a known phrase.
    """
    words = _count(F.trim(line), " ") + 1
    punctuation = F.regexp_count(line, F.lit("[#*$%&!?]{2,}")) * 4 > words
    navigation = _count(line, SEPARATORS) * 4 > words
    # most lines have no address: looking for its marks is cheaper than the pattern
    links = ((F.instr(line, "www.") > 0) | (F.instr(line, "://") > 0) | (F.instr(line, "@") > 0)) & (F.regexp_count(line, F.lit(r"https?://|www\.|[A-Za-z0-9]@[A-Za-z0-9]")) * 4 > words)
    boilerplate = (F.char_length(line) < 300) & F.lower(line).rlike("|".join(BOILERPLATE))
    return punctuation | navigation | links | boilerplate


def _entry(line: Column) -> Column:
    """Whether a line could be an entry of a menu."""
    bare = F.trim(line)
    return (bare != "") & (_count(bare, " ") < MENU_WORDS) & ~bare.rlike(r"[.!?:;…,][\"'»”)]*\z")


def kept_lines(lines: Column) -> Column:
    """The lines that pass every rule; entries that stand in a run of ``MENU_LINES`` or more fail."""

    def passing(entries: Column) -> Column:
        at = lambda i: (i >= 0) & F.coalesce(F.get(entries, i), F.lit(False))

        def menu(i: Column) -> Column:
            runs = [[at(i + first + k) for k in range(MENU_LINES)] for first in range(1 - MENU_LINES, 1)]
            return F.get(entries, i) & reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, run) for run in runs))

        return F.filter(lines, lambda x, i: ~(menu(i) | failing(x)))

    return _let(F.transform(lines, _entry), passing)


def _repeated(words: Column) -> Column:
    """Words inside a 3-word window that occurs more than once."""

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(positions, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def few(hashes: Column, twice: Column) -> Column:
        return covered(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, F.get(hashes, i))))

    def many(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return covered(F.sort_array(F.transform(found, lambda k: F.get(s, k)["i"])))

        return _let(pairs, positions)

    def counted(hashes: Column) -> Column:
        twice = _let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False)))))
        # looking each window up in a short list is cheaper than sorting pairs; for a long list it is not
        return _let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0).cast("bigint")).when(F.size(t) <= 64, few(hashes, t)).otherwise(many(hashes)))

    # words must be bound here (see judge), or each element would split the text again
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(_let(hashes, counted))


def judge(docs: DataFrame, most_lost: float = 0.5, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Measures and verdict of every row, beside the row itself.

    Input: ``text``; the input row comes back as the struct ``row``, so its column
    names can be any.  Output: ``row``, the base measures ``n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words`` (bigint), ``base_failed``, ``clean``
    (the text without failing lines), ``lost`` (share of the characters in words
    that went with them) and ``kept``.

    A null text has no words and fails the base rules, as an empty text does; its
    ``clean`` stays null.  Repeated rows are judged alike; an empty table gives
    no rows.  Two different windows count as one with probability 2**-64 a pair.
    """
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("t"), F.col("text").isNull().alias("absent"))
    words = F.filter(F.split("t", _SPLIT), lambda w: w != "")
    lines = F.split("t", "\n")
    full = F.filter(lines, lambda x: _drop(x, _BLANKS) != "")
    measured = F.struct(
        _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated(w).alias("repeated"))).alias("words"),
        F.char_length(_drop(F.col("t"), _BLANKS)).cast("bigint").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        _let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        F.array_join(_let(lines, kept_lines), "\n").alias("clean"),
    )
    # a generator is a barrier: a filter on the verdict above must not measure the text a second time below
    d = d.select("row", "absent", F.explode(F.array(measured)).alias("m"))
    d = d.select("row", "absent", F.col("m.words.n").alias("n_words"), "m.word_chars", "m.n_symbols", "m.n_dup_lines", F.col("m.words.repeated").alias("n_repeat_words"), "m.clean")
    lost = F.col("word_chars") - F.char_length(_drop(F.col("clean"), _BLANKS))
    d = d.withColumn("base_failed", (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated))
    d = d.withColumn("lost", F.when(F.col("word_chars") > 0, lost / F.col("word_chars")).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & (lost <= F.col("word_chars") * F.lit(most_lost)))
    return d.withColumn("clean", F.when(~F.col("absent"), F.col("clean"))).drop("absent")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of ``docs``, with failing lines removed from ``text``."""
    return judge(docs, **limits).filter("kept").select(*((F.col("clean") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
judged AS (SELECT doc_id, l, i, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(regexp_replace(trim(l, ' '), '[^ ]', '', 'g')) + 1 AS n,
  len(regexp_extract_all(l, '[#*$%&!?]{2,}')) AS marks,
  len(regexp_extract_all(l, 'https?://|www\.|[A-Za-z0-9]@[A-Za-z0-9]')) AS links,
  trim(l, ' ') <> '' AND length(regexp_replace(trim(l, ' '), '[^ ]', '', 'g')) < 3 AND NOT regexp_matches(trim(l, ' '), '[.!?:;…,]["''»”)]*\z') AS entry,
  length(l) - length(regexp_replace(l, '[|»›•·]', '', 'g')) AS seps,
  length(l) < 300 AND regexp_matches(lower(l), '@PHRASES@') AS boiler
  FROM line),
menus AS (SELECT *, entry AND count(*) OVER (PARTITION BY doc_id, entry, run) >= 4 AS menu FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, entry ORDER BY i) AS run FROM judged)),
per AS (SELECT doc_id, sum(chars) AS all_chars, sum(CASE WHEN marks * 4 > n OR seps * 4 > n OR links * 4 > n OR boiler OR menu THEN chars ELSE 0 END) AS lost,
  count(*) FILTER (WHERE chars > 0) - count(DISTINCT l) FILTER (WHERE chars > 0) AS dup FROM menus GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= word_chars * 0.5 AS kept FROM (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, per.dup::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws) AS base_failed, lost
  FROM w JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
""".replace("@PHRASES@", "|".join(BOILERPLATE))
