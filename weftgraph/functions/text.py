"""Scalar functions over names, URLs, receipts and labels (all JVM-side expressions)."""

from __future__ import annotations

from functools import cache, reduce
from re import _constants as _op  # the parse tree of a pattern has no public module
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, so that it is computed once.

    What is bound is evaluated as a tree of expressions; as generated code, dozens of patterns make a method that is too long to be compiled further.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _literals(tree, fold: bool) -> list[tuple[str, bool]] | None:
    """Texts of which each match of a parsed pattern holds one (``fold``: in any case); None if there are none."""
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is _op.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append([(run, fold)])
            run = ""
        if op is _op.SUBPATTERN:
            _, on, off, inner = arg
            found.append(_literals(inner, (fold or bool(on & _op.SRE_FLAG_IGNORECASE)) and not off & _op.SRE_FLAG_IGNORECASE))
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(_literals(arg[2], fold))
        elif op is _op.ATOMIC_GROUP:
            found.append(_literals(arg, fold))
        elif op is _op.BRANCH:
            each = [_literals(b, fold) for b in arg[1]]
            found.append(None if None in each else [x for e in each for x in e])
        elif op is _op.IN and all(o is _op.LITERAL for o, _ in arg):
            found.append([(chr(a), fold) for _, a in arg])
    # four characters tell enough; of those the fewest texts
    least = lambda texts: min(len(t) for t, _ in texts)
    return max((f for f in found if f), key=lambda f: (min(4, least(f)), -len(f), least(f)), default=None)


@cache
def literals(pattern: str) -> tuple[tuple[str, bool], ...]:
    """Texts of which each match of a pattern holds one, ``(text, fold)``; none if that can't be said.

    With ``fold`` the text is in lower case and stands for any case of it.
    """
    try:
        tree = _parser.parse(pattern)
    except _op.PatternError:
        return ()
    some = {(t.lower() if f else t, f) for t, f in _literals(tree, bool(tree.state.flags & _op.SRE_FLAG_IGNORECASE)) or []}
    if not all(t.isascii() for t, _ in some):
        return ()
    return tuple(sorted((t, f) for t, f in some if not any(o != t and o in t and g == f for o, g in some)))


def may_match(text: Column, *patterns: str) -> Column:
    """False only where none of the patterns can match: searching for fixed texts is far cheaper than trying a pattern at every place."""
    some = {x for p in patterns for x in literals(p)}
    if not all(literals(p) for p in patterns):
        return F.lit(True)
    return reduce(lambda a, b: a | b, ((F.lower(text) if fold else text).contains(t) for t, fold in sorted(some)))


def matches(text: Column, pattern: str) -> Column:
    """rlike, after a search for the texts that the pattern can't do without."""
    return may_match(text, pattern) & text.rlike(pattern)


def last_segment(name: Column) -> Column:
    """Last part of a URL, ARN, module path or dotted key."""
    return F.element_at(F.split(name, r"[/:]"), -1)


def last_dotted(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def snake(name: Column) -> Column:
    """camelCase as snake_case."""
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def shouty(name: Column) -> Column:
    """A key as SHOUTY_SNAKE."""
    return F.upper(F.regexp_replace(snake(name), r"[^A-Za-z0-9]+", "_"))


def dotted(name: Column) -> Column:
    """A key as dotted.lower."""
    return F.lower(F.regexp_replace(snake(name), r"[^A-Za-z0-9]+", "."))


def spellings(name: Column) -> Column:
    """The spellings under which a configuration key may be declared."""
    return F.array_distinct(F.array(name, shouty(name), dotted(name), last_dotted(name), snake(name)))


def without_scope(name: Column) -> Column:
    """Package name without its @scope/."""
    return F.regexp_replace(name, r"^@[^/]+/", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")


def host(url: Column) -> Column:
    """Host of a URL, without user information and port; null without a scheme."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def scheme(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.when(found != "", found)


def engine(url: Column) -> Column:
    """Engine label of a data-source URL, so that credentials never reach a label."""
    kinds = {"sql": ["postgres", "postgresql", "mysql", "mariadb", "jdbc", "sqlserver", "oracle", "cockroachdb", "clickhouse"], "redis": ["redis", "rediss", "valkey"], "mongo": ["mongodb", "mongodb+srv"], "s3": ["s3", "s3a"]}
    s, out = scheme(url), F.lit(None).cast("string")
    for label, schemes in kinds.items():
        out = F.when(s.isin(*schemes), F.lit(label)).otherwise(out)
    return out


def store_kind(image: Column) -> Column:
    """Kind of node that a container image stands for; null for images that are not stores."""
    name = F.lower(F.regexp_extract(image, r"^(?:.*/)?([^/:@]+)(?:[:@].*)?$", 1))
    return F.when(name.rlike(r"^(postgres|mysql|mariadb|mongo|cassandra|clickhouse)"), "db").when(name.rlike(r"^(redis|valkey|memcached)"), "cache").when(name.rlike(r"^(elasticsearch|opensearch|minio|localstack)"), "store")


def is_broker(image: Column) -> Column:
    return F.lower(image).rlike(r"(^|/)(cp-)?(kafka|zookeeper|rabbitmq|nats|redpanda|activemq|pulsar)[^/]*(:|$)")


def is_loopback(name: Column) -> Column:
    return F.lower(name).rlike(r"^(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::\]|::|host\.docker\.internal|([^/]+\.)?example(\.[a-z]+)?)$")


def template(path: Column) -> Column:
    """URL path with concrete ids as {id} and without its query string."""
    bare = F.regexp_replace(path, r"[?#].*$", "")
    named = F.regexp_replace(bare, r"/(?::[A-Za-z_][A-Za-z0-9_]*|\{[^/}]*\}|<[^/>]*>|\$\{[^/}]*\})(?=/|$)", "/{id}")
    return F.regexp_replace(named, r"/(?:[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(?=/|$)", "/{id}")


def http_label(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), template(path))


def valid_channel(name: Column) -> Column:
    """A channel's name: no number, boolean, path, sentence or class name."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.rlike(r"^([0-9]+|(?i:true|false|null|none)|[A-Z][a-z0-9]+([A-Z][a-z0-9]*)+)$")


def elide(label: Column, most: int = 28) -> Column:
    """Label of at most ``most`` characters, cut in the middle."""
    head = most // 2
    tail = most - 1 - head
    return F.when(F.char_length(label) > most, F.concat(F.substring(label, 1, head), F.lit("…"), F.right(label, F.lit(tail)))).otherwise(label)


def mermaid_id(kind: Column, name: Column) -> Column:
    """Diagram id: a prefix by kind, and underscores for everything but letters and digits."""
    prefix = F.when(kind.isin("svc", "ref"), "s_").when(kind.isin("topic", "queue"), "t_").when(kind == "ext", "x_").otherwise("d_")
    return F.concat(prefix, F.regexp_replace(name, "[^A-Za-z0-9]", "_"))


def xml_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&lt;br&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def token_estimate(text: Column) -> Column:
    """Tokens of a text, at four bytes each."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def top_dir(path: Column) -> Column:
    return F.split(path, "/")[0]


def prefixes(path: Column) -> Column:
    """Every directory above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def receipt_text(receipts: Column) -> Column:
    """``path:1,2; other:3``."""
    return F.array_join(F.transform(receipts, lambda r: F.concat(r["path"], F.lit(":"), F.array_join(r["lines"].cast("array<string>"), ","))), "; ")


def receipt_cell(receipts: Column) -> Column:
    """Receipts as they stand in a view's table."""
    return F.array_join(F.transform(receipts, lambda r: F.concat(F.lit("`"), r["path"], F.lit(":"), F.array_join(r["lines"].cast("array<string>"), ","), F.lit("`"))), " · ")


def parse_receipts(text: Column) -> Column:
    """Receipts of ``path:1,2; other:3``; a path may hold colons, so the numbers are anchored at the end."""
    item = r"^(.*):([0-9][0-9,]*)$"
    parsed = F.transform(F.split(text, "; "), lambda x: F.struct(F.regexp_extract(x, item, 1).alias("path"), F.transform(F.filter(F.split(F.regexp_extract(x, item, 2), ","), lambda n: n != ""), lambda n: n.cast("int")).alias("lines")))
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<struct<path:string,lines:array<int>>>")).otherwise(parsed)


def caption(actor: Column, object_: Column, label: Column, tag: Column) -> Column:
    arrow = F.when(tag == "CODE", " → ").otherwise(" ⇢ ")
    return F.concat(actor, arrow, object_, F.when(label.isNull() | (label == "-"), "").otherwise(F.concat(F.lit(" · "), label)))
