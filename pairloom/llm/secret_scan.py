"""Secret scans through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that any
match must contain. One pass over the texts makes the index: for each of the
queries' trigrams and each bucket of documents the posting list of those that
hold it. A query is answered bucket by bucket, by intersecting posting lists
and uniting the results of alternatives. The expression then runs on these
candidates alone, in a second pass in which texts stay where they are while
the candidates are few enough to be sent to them. A rule without mandatory
trigrams runs on every document.

All of it is DataFrame and SQL functions; the queries are derived from the
expressions once, on the driver, when the plan is made.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import let
from .storage import keep


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # understood alike by Java, RE2 and Python
    group: int = 0
    least: int = 1  # characters of the group; shorter matches are dropped
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    # a maximal run of 16 or more is what a run less short ones comes to
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)

#: Alternatives that the derivation spells out before it gives up on a stretch.
MOST_STRINGS = 32
#: Trigrams of an alternative that are looked up, the ones that most alternatives have first; of many alternatives one each.
LOOKED_UP, FEW = 2, 4
#: Postings of a bucket, on average.
BUCKET_POSTINGS = 65_536
#: Candidates are sent to every task up to this many (about 40 MB); beyond, documents and candidates are joined by key.
SENT_ROWS = 400_000
#: Matches whose places are summed up before those of the next are.
CHUNK = 256

#: A query: all of its clauses hold; a clause: one of its sets of trigrams is present as a whole.
Query = list[frozenset]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def clause(strings: set[str]) -> Query:
    options = {trigrams(s) for s in strings}
    return [] if frozenset() in options else [frozenset(options)]


def thinned(query: Query) -> Query:
    """A weaker query over fewer trigrams: it lets more documents through and misses none."""
    out = []
    for options in query:
        often = {t: sum(t in o for o in options) for o in options for t in o}
        most = LOOKED_UP if len(options) <= FEW else 1
        out.append(frozenset(frozenset(sorted(o, key=lambda t: (-often[t], t))[:most]) for o in options))
    return out


def derive(pattern: str) -> Query:
    """The trigram query of a regular expression, in lower case; empty if it has no mandatory trigram."""
    query, open_ends = walk(re._parser.parse(pattern))
    return query + clause(open_ends)


def strings_of(node) -> set[str] | None:
    """All strings of one node, in lower case, if they are few."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return sequence_strings(value[3])
    if op is sre.BRANCH:
        parts = [sequence_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and value[1] == 1:
        inner = sequence_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = strings_of(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def walk(nodes) -> tuple[Query, set[str]]:
    """Clauses of a sequence, and the strings that end it and may still grow."""
    query: Query = []
    ends = {""}
    for node in nodes:
        more = strings_of(node)
        if more is not None and len(ends) * len(more) <= MOST_STRINGS:
            ends = {a + b for a in ends for b in more}
            continue
        query += clause(ends)
        ends = more or {""}
        if more is None and node[0] is sre.SUBPATTERN:
            inner, ends = walk(node[1][3])
            query += inner
        elif more is None and node[0] is sre.MAX_REPEAT and node[1][0] >= 1:
            inner, last = walk(node[1][2])
            query += inner + clause(last)
    return query, ends


def row_key(id_col: str, text: Column) -> Column:
    """128 bits that name an id and text, never null; rows that repeat both share it."""
    halves = (F.xxhash64(F.lit(1), F.col(id_col), text), F.xxhash64(F.lit(2), text, F.col(id_col)))
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves])


def inverted_index(docs: DataFrame, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    """``bucket, trigram, postings``: the documents, by key, whose lower-case text holds the trigram."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowered = docs.select(row_key(id_col, text).alias("_key"), F.lower(text).alias("_low"))
    held = F.filter(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    postings = keep(lowered.select("_key", F.explode(held).alias("trigram")), "postings")
    buckets = max(1, -(-postings.count() // BUCKET_POSTINGS))
    return postings.groupBy(F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("bucket"), "trigram").agg(F.collect_set("_key").alias("postings"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``_key, kinds``: documents that the posting lists leave for one rule or more."""
    none = F.array().cast("array<string>")

    def found(lists: Column, query: Query) -> Column:
        clauses = []
        for options in query:
            each = [reduce(F.array_intersect, [F.coalesce(F.try_element_at(lists, F.lit(t)), none) for t in sorted(o)]) for o in sorted(options, key=sorted)]
            clauses.append(reduce(F.array_union, each))
        return reduce(F.array_intersect, clauses)

    lists = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))

    def tagged(kind: str, query: Query) -> Column:
        return F.transform(found(F.col("lists"), query), lambda k: F.struct(k.alias("_key"), F.lit(kind).alias("kind")))

    hits = [tagged(kind, q) for kind, q in queries.items()]
    pairs = lists.select(F.explode(F.concat(*hits)).alias("x")).select("x._key", "x.kind")
    return pairs.groupBy("_key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


SPAN = "struct<start:int,rank:int,end:int,kind:string,base:boolean>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches in code points, leftmost and without overlap; short ones are dropped.

    The pieces between the matches and the matches themselves add up to the
    text, so running lengths give the places. They are summed in chunks, so
    that a text of very many matches takes no more than time in proportion.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def piece(gap: Column, hit: Column) -> Column:
        part = F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit
        return F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"), (F.length(part) >= rule.least).alias("good"))

    def inside(chunk: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base"))
            return F.struct((start + x["n"]).alias("at"), F.when(x["good"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), none.alias("out")), step)["out"]

    def placed(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["n"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(lengths, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(chunks, starts, inside))

    def chunked(pieces: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(CHUNK)), lambda i: F.slice(pieces, i, F.lit(CHUNK))), placed)

    def matched(hits: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
        return F.when(F.size(hits) == 0, none).otherwise(let(F.zip_with(gaps, hits, piece), chunked))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), matched)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: every row with its spans, an array of ``start, rank, end, kind, base`` in text order.

    A null text is empty and has no spans. Null and repeated ids are returned
    row by row; an empty table gives no rows; other columns are not read.
    Whole texts are scanned, however long.
    """
    queries = {r.kind: thinned(derive(r.pattern)) for r in rules}
    queries = {k: q for k, q in queries.items() if q}
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), row_key(id_col, text).alias("_key"))
    none = F.array().cast(f"array<{SPAN}>")
    asked = F.coalesce("kinds", F.array().cast("array<string>"))
    if queries:
        wanted = sorted({t for q in queries.values() for c in q for s in c for t in s})
        likely = keep(candidates(inverted_index(docs, id_col, text_col, wanted), queries), "candidates")
        keyed = keyed.join(F.broadcast(likely) if likely.count() <= SENT_ROWS else likely, "_key", "left")
    found = [spans_of(F.col("_text"), r, i) if r.kind not in queries else F.when(F.array_contains(asked, r.kind), spans_of(F.col("_text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return keyed.select("doc_id", F.sort_array(F.concat(*found, none)).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text."""

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return found.select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind
