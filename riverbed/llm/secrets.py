"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. The index
holds, for the trigrams that occur in any rule's query, which documents contain them (A-Z folded). Intersecting the
postings gives each rule's candidate documents; the rule's expression then verifies those. A rule without a mandatory
trigram scans all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import materialize


@dataclass(frozen=True)
class Rule:
    """``group``: its text must have ``least`` characters, else the match is dropped (but has used up its place)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # a run shorter than 24 uses up no place that a longer one could take
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
#: Strings of an exact set, members of a character class and clauses of a query beyond which no more is asked for.
MOST_STRINGS, MOST_CHARS, MOST_CLAUSES = 64, 8, 64
Query = frozenset | None


def _lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _any_of(strings: set[str]) -> Query:
    """Trigrams that a text with one of the strings has: an OR of ANDs, None for no demand."""
    if min(map(len, strings)) < 3:
        return None
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    made = frozenset(x | y for x in a for y in b)
    return made if len(made) <= MOST_CLAUSES else min(a, b, key=len)


def _either(queries: list[Query]) -> Query:
    return None if any(q is None for q in queries) else frozenset().union(*queries)


def _analyse(tree) -> tuple[set[str] | None, Query]:
    """The strings that the part matches, if they are few, and its query."""
    query, strings, broken = None, {""}, False
    for kind, arg in tree:
        exact: set[str] | None = None
        inner: Query = None
        if kind is op.LITERAL:
            exact = {_lower(chr(arg))}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            chars = {_lower(chr(c)) for _, c in arg}
            exact = chars if len(chars) <= MOST_CHARS else None
        elif kind is op.SUBPATTERN:
            exact, inner = _analyse(arg[3])
        elif kind is op.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                inner = _either([q if e is None else _any_of(e) for e, q in parts])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, part = arg
            one, q = _analyse(part)
            if one is not None and high == 1:
                exact = one | ({""} if low == 0 else set())
            elif low > 0:
                inner = q if one is None else _any_of(one)
        elif kind is op.AT:
            continue
        if exact is None:
            query, strings, broken = _both(_both(query, _any_of(strings)), inner), {""}, True
        elif len(strings) * len(exact) > MOST_STRINGS:
            query, strings, broken = _both(query, _any_of(strings)), exact, True
        else:
            strings = {a + b for a in strings for b in exact}
    return (None, _both(query, _any_of(strings))) if broken else (strings, None)


def trigram_query(pattern: str) -> Query:
    """Clauses of which each match satisfies one with all its trigrams (A-Z folded); None: none is mandatory."""
    exact, query = _analyse(parser.parse(pattern))
    return query if exact is None else _any_of(exact)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram, doc_id`` of the given trigrams."""
    folded = docs.select("doc_id", F.lower("text").alias("folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("doc_id", F.explode(present).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, kinds``: the documents in which a rule with mandatory trigrams may match, from the postings alone."""
    lists = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))
    kinds = []
    for rule in rules:
        clauses = [F.size(F.array_except(F.array(*map(F.lit, sorted(c))), "have")) == 0 for c in trigram_query(rule.pattern) or ()]
        if clauses:
            met = clauses[0]
            for c in clauses[1:]:
                met = met | c
            kinds.append(F.when(met, F.lit(rule.kind)))
    return lists.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _place(rule: Rule, rank: int, text: Column, found: Column) -> Column:
    """Leftmost non-overlapping matches as structs; positions from the lengths of the matches and of what is between."""
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), sizes.alias("v"))
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, empty, step, lambda acc: acc["spans"])).otherwise(F.array().cast(kind))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text, spans`` for each row: ``spans`` holds ``start, rank, end, kind`` of all secrets, by start and rank.

    Positions are code points, the end exclusive. A null text is empty; a null ``doc_id`` is a value like another, and
    rows with one ``doc_id`` share candidates but each is verified by itself. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for c in q or () for t in c})
    found = materialize(candidates(trigram_index(docs, trigrams), rules), "secrets").select(F.col("doc_id").alias("own"), "kinds")
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found["own"]), "left").drop("own")
    hits = []
    for rule in rules:
        here = F.lit(True) if queries[rule.kind] is None else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        hits.append(F.when(here, found).otherwise(F.array().cast("array<string>")).alias(f"hits_{rule.kind}"))
    rows = rows.select("doc_id", "text", *hits)
    placed = [_place(r, k, F.col("text"), F.col(f"hits_{r.kind}")) for k, r in enumerate(rules)]
    return rows.select("doc_id", "text", F.array_sort(F.concat(*placed)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
