"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its syntax tree follows a Boolean query
of trigrams that any match must contain. Postings are built for the trigrams
that the rules ask for, intersected and united per rule, and only the texts left
are verified with the expression itself. Rules without mandatory trigrams scan
every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as S
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``least`` is the fewest code points of ``group`` (0: the whole match).

    ``pattern`` must mean the same to Python and Java and must not match the
    empty string. ``(?i)`` in front: letters A-Z in either case.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The three base kinds.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=12,
        group=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # maximal runs of 16 and more: the same matches as [0-9a-f]+ cut at 16
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Published formats of well-known credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"[a-z]{2,10}://[^/\s:@]{1,64}:[^/\s:@]{1,64}@[a-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 64  # alternatives kept apart; beyond, a query asks for less

# A query is a set of alternatives, each a set of trigrams that must all occur.
# None stands for "any text".
Query = frozenset[frozenset[str]] | None


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _fewest(query: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return query and frozenset(a for a in query if not any(b < a for b in query))


def _either(queries: list[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    return _fewest(frozenset().union(*queries))


def _stricter(a: Query, b: Query) -> Query:
    """Both must hold; where the product is too large, the one with fewer alternatives."""
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > _MOST_STRINGS:
        return min(a, b, key=len)
    return _fewest(frozenset(x | y for x, y in product(a, b)))


def _of_strings(strings: frozenset[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _fewest(frozenset(_trigrams(s) for s in strings))


def _exact(node) -> frozenset[str] | None:
    """All strings a node can match, in lower case, if they are few."""
    op, arg = node
    if op is S.LITERAL:
        return frozenset([chr(arg).lower()])
    if op is S.IN:
        found = set()
        for kind, value in arg:
            if kind is S.LITERAL:
                found.add(chr(value).lower())
            elif kind is S.RANGE and value[1] - value[0] < 8:
                found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return frozenset(found) if len(found) <= 8 else None
    if op is S.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is S.BRANCH:
        parts = [_exact_sequence(p) for p in arg[1]]
        return None if any(p is None for p in parts) else frozenset().union(*parts)
    if op in (S.MAX_REPEAT, S.MIN_REPEAT):
        low, high, inner = arg
        strings = _exact_sequence(inner)
        if strings is None or high is S.MAXREPEAT or len(strings) ** int(high) > _MOST_STRINGS or high > 16:
            return None
        return frozenset("".join(p) for n in range(low, int(high) + 1) for p in product(strings, repeat=n))
    if op is S.AT:
        return frozenset([""])
    return None


def _exact_sequence(nodes) -> frozenset[str] | None:
    strings = frozenset([""])
    for node in nodes:
        more = _exact(node)
        if more is None or len(strings) * len(more) > _MOST_STRINGS:
            return None
        strings = frozenset(a + b for a, b in product(strings, more))
    return strings


def _query(nodes) -> Query:
    """What a sequence of nodes asks for: runs of known strings, and single nodes' own queries."""
    asked: Query = None
    run = frozenset([""])
    for node in nodes:
        strings = _exact(node)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        asked = _stricter(asked, _of_strings(run))
        run = strings if strings is not None else frozenset([""])
        op, arg = node
        if strings is None and op is S.SUBPATTERN:
            asked = _stricter(asked, _query(arg[3]))
        elif strings is None and op is S.BRANCH:
            asked = _stricter(asked, _either([_query(p) for p in arg[1]]))
        elif strings is None and op in (S.MAX_REPEAT, S.MIN_REPEAT) and arg[0] >= 1:
            asked = _stricter(asked, _query(arg[2]))
    return _stricter(asked, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, one of which every match contains whole; None: no demand."""
    return _query(_parser.parse(pattern))


_SPANS = "array<struct<start:int,end:int,kind:string>>"


def _rule_rows(rules: tuple[Rule, ...]) -> Column:
    """The rules as an array value, so that one expression serves them all."""
    return F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.pattern).alias("pattern"),
                F.lit(r.group).alias("group"),
                F.lit(r.least).alias("least"),
            )
            for r in rules
        ]
    )


def find_spans(text: Column, rule: Column) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start, end, kind>>`` in code points.

    The text is split at the matches, so each span starts where the pieces and
    matches before it end.
    """
    whole = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    value = F.regexp_extract_all(text, rule["pattern"], rule["group"])
    parts = F.arrays_zip(
        F.transform(F.split(text, rule["pattern"], -1), F.char_length).alias("p"),
        F.transform(whole, F.char_length).alias("m"),
        F.transform(value, F.char_length).alias("v"),
    )
    none = F.array().cast(_SPANS)

    def step(a, x):
        start, end = a["at"] + x["p"], a["at"] + x["p"] + F.coalesce(x["m"], F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), rule["kind"].alias("kind"))
        kept = F.when(x["v"] >= rule["least"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.rlike(text, rule["pattern"]), F.aggregate(parts, start, step, lambda a: a["spans"])).otherwise(none)


def _folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def candidates(df: DataFrame, text: str, rules: tuple[Rule, ...], block_rows: int = 20_000) -> DataFrame:
    """``secret_key, secret_rules``: the rules that a text may match, by hash of the text.

    Postings are kept in blocks of about ``block_rows`` texts, whose number
    follows the table's. Copies of a text share one posting. Two texts with one
    hash only share their candidates, which are verified anyway.
    """
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    words = sorted({t for q in asked.values() for a in q for t in a})
    blocks = max(1, -(-df.count() // block_rows))
    folded = df.select(F.xxhash64(F.col(f"`{text}`")).alias("secret_key"), _folded(F.col(f"`{text}`")).alias("folded"))
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("folded"), w))
    postings = folded.select("secret_key", F.explode(held).alias("trigram"))
    lists = postings.groupBy(F.pmod("secret_key", F.lit(blocks)).alias("block"), "trigram").agg(
        F.collect_set("secret_key").alias("keys")
    )
    index = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("index"))
    empty = F.array().cast("array<bigint>")
    posting = lambda w: F.coalesce(F.try_element_at("index", w), empty)
    every = lambda alternative: F.aggregate(
        alternative, posting(alternative[0]), lambda held, w: F.array_intersect(held, posting(w))
    )
    either = lambda query: F.aggregate(query, empty, lambda held, x: F.array_union(held, every(x)))
    demands = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.array(*[F.array(*[F.lit(w) for w in sorted(x)]) for x in sorted(q, key=sorted)]).alias("query"),
            )
            for kind, q in asked.items()
        ]
    )
    found = F.transform(demands, lambda d: F.struct(d["kind"].alias("kind"), either(d["query"]).alias("keys")))
    hits = index.select(F.explode(found).alias("hit")).select(
        F.col("hit.kind").alias("kind"), F.explode("hit.keys").alias("secret_key")
    )
    return hits.groupBy("secret_key").agg(F.collect_set("kind").alias("secret_rules"))


def scan_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``secret_spans``: ``array<struct<start, end, kind>>`` of all rules.

    Spans are in code points, end exclusive, ordered by start and then by the
    order of ``rules``. Null and empty texts have none. Repeated rows are
    scanned alike; every row of ``df`` appears once, with all its columns. Names
    ``secret_key``, ``secret_rules`` and ``secret_spans`` are not allowed in ``df``.
    """
    taken = {"secret_key", "secret_rules", "secret_spans"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made by scan_secrets; rename yours")
    names = [F.col(f"`{c}`") for c in df.columns]
    asked = {r.kind for r in rules if trigram_query(r.pattern) is not None}
    keyed = df.withColumn("secret_key", F.xxhash64(F.col(f"`{text}`")))
    if asked:
        keyed = keyed.join(candidates(df, text, rules), "secret_key", "left")
    else:
        keyed = keyed.withColumn("secret_rules", F.lit(None).cast("array<string>"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    scanned = F.filter(
        _rule_rows(rules),
        lambda r: ~r["kind"].isin(*asked) | F.coalesce(F.array_contains("secret_rules", r["kind"]), F.lit(False)),
    )
    spans = F.flatten(F.transform(scanned, lambda r: find_spans(whole, r)))
    order = F.array(*[F.lit(r.kind) for r in rules])
    ranked = F.sort_array(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.array_position(order, s["kind"]).alias("rank"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
    )
    listed = F.transform(
        ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return keyed.select(*names, listed.alias("secret_spans"))


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in place of the union of the spans; a null text stays null.

    Overlapping and touching spans become one mark.
    """
    whole = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    folded = F.aggregate(
        F.col(spans),
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] > a["at"]) | ((a["at"] == 0) & (s["start"] == 0)),
                F.concat(a["parts"], F.array(F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))),
            )
            .otherwise(a["parts"])
            .alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(whole, a["at"] + 1, F.char_length(whole))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, folded).otherwise(whole))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
