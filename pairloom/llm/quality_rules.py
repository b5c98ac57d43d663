"""Quality rules as a short-circuit cascade.

A rule looks at whole texts and rejects some. Its cost and selectivity are
estimated on a bounded sample; rules are then ordered by rejections per
second, and each rule sees only what the rules before it have let through. A
document is kept when no rule rejects it, so the order decides the work, never
the verdict. What a rule has measured (words, lines, symbols) the rules after
it find measured, each for the texts that are left.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import WHITE, counts, row_chunks, text_bytes, window_hashes, word_hashes, word_spans

WINDOW = 8
MIN_WORDS = 20
#: Texts of the sample, which come from all partitions; with the bound on their length it is 26 MB at most.
SAMPLE_ROWS = 256
#: Sampled texts are shorter than this; it bears on the order of the rules alone.
SAMPLE_CHARS = 100_000

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
FIRST_BYTE = np.ones(256, dtype=bool)
FIRST_BYTE[128:192] = False
INK_CHAR = FIRST_BYTE & ~WHITE


def measured(f: Callable[[Texts], np.ndarray]) -> Callable[[Texts], np.ndarray]:
    """A figure of each text, found once; texts taken from others take their figures along."""

    @wraps(f)
    def found(t: Texts) -> np.ndarray:
        if f.__name__ not in t.known:
            t.known[f.__name__] = f(t)
        return t.known[f.__name__]

    return found


class Texts:
    """The texts of one slice of a batch, with what has been measured of them."""

    def __init__(self, column: pa.Array, known: dict[str, np.ndarray] | None = None):
        self.column, self.known = column, known or {}

    def __len__(self) -> int:
        return len(self.column)

    def take(self, at: np.ndarray) -> Texts:
        return Texts(self.column.take(pa.array(at)), {k: v[at] for k, v in self.known.items()})

    @cached_property
    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return text_bytes(self.column)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(*self.bytes)

    def count(self, flags: np.ndarray) -> np.ndarray:
        data, offsets = self.bytes
        return counts(flags[data], offsets)


@measured
def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.spans[2]).astype(np.int64)


@measured
def word_chars(t: Texts) -> np.ndarray:
    return t.count(INK_CHAR)


@measured
def n_symbols(t: Texts) -> np.ndarray:
    return t.count(SYMBOL)


@measured
def line_counts(t: Texts) -> np.ndarray:
    """Lines with a word, and those of them that equal an earlier line, as two columns."""
    data, offsets = t.bytes
    out = np.zeros((len(t), 2), dtype=np.int64)
    for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        inked = [x for x in data[lo:hi].tobytes().split(b"\n") if x.strip()]
        out[i] = len(inked), len(inked) - len(set(inked))
    return out


@measured
def n_repeat_words(t: Texts) -> np.ndarray:
    """Words inside windows of eight words that occur twice or more in their text, the first occurrence included."""
    starts, ends, first = t.spans
    words = word_hashes(t.bytes[0], starts, ends)
    out = np.zeros(len(first) - 1, dtype=np.int64)
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
        windows = window_hashes(words[lo:hi], WINDOW)
        if len(windows) < 2:
            continue
        ordered = np.sort(windows)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            edge = np.zeros(hi - lo + 1, dtype=np.int64)
            at = np.flatnonzero(np.isin(windows, again))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            out[i] = np.count_nonzero(np.cumsum(edge[:-1]))
    return out


def too_short(t: Texts) -> np.ndarray:
    return n_words(t) < MIN_WORDS


def repetitive(t: Texts) -> np.ndarray:
    return 100 * n_repeat_words(t) > 30 * n_words(t)


def symbol_heavy(t: Texts) -> np.ndarray:
    """More than one of ``#*$%&|<>`` for ten words."""
    return 10 * n_symbols(t) > n_words(t)


def odd_words(t: Texts) -> np.ndarray:
    """Words shorter than 2 or longer than 15 characters on average."""
    chars, words = word_chars(t), n_words(t)
    return (chars < 2 * words) | (chars > 15 * words)


def copied_lines(t: Texts) -> np.ndarray:
    """More than half of the lines repeat an earlier one."""
    lines, copies = line_counts(t).T
    return 2 * copies > lines


def shouting(t: Texts) -> np.ndarray:
    """More than six of ten unaccented letters in upper case."""
    return 10 * t.count(UPPER) > 6 * t.count(LETTER)


Rule = Callable[[Texts], np.ndarray]
RULES: dict[str, Rule] = {f.__name__: f for f in (too_short, symbol_heavy, odd_words, shouting, copied_lines, repetitive)}
BASE_RULES = ("too_short", "repetitive")


def profile(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int, int, float]]:
    """``(rule, documents, rejected, seconds)`` on a uniform sample of ``sample_rows`` texts.

    Some four times as many are drawn from all partitions at one rate, so that
    what goes to the driver is the same at any size, and the first of them in
    random order are taken.
    """
    rate = min(1.0, 4 * sample_rows / max(1, docs.count()))
    drawn = docs.select(F.col(text_col).alias("text")).sample(rate, 42).where(F.length("text") < SAMPLE_CHARS)
    rows = drawn.orderBy(F.rand(42)).take(sample_rows)
    column = pa.array([r[0] for r in rows], type=pa.string())
    out = []
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = rule(Texts(column))
        out.append((name, len(rows), int(rejected.sum()), time.perf_counter() - began))
    return out


def order_rules(profiled: list[tuple[str, int, int, float]]) -> list[str]:
    """Rules by rejections per second, most first; rules that reject none of the sample come last, cheapest first."""
    return [name for name, _, _, _ in sorted(profiled, key=lambda r: (-r[2] / max(r[3], 1e-9), r[3], r[0]))]


def passes(texts: Texts, order: list[str], rules: dict[str, Rule]) -> np.ndarray:
    """Whether each text passes all rules; a text is not looked at again once it is rejected."""
    alive, left = np.arange(len(texts)), texts
    for name in order:
        if not len(alive):
            break
        passed = ~rules[name](left)
        if not passed.all():
            alive, left = alive[passed], left.take(np.flatnonzero(passed))
    kept = np.zeros(len(texts), dtype=bool)
    kept[alive] = True
    return kept


def keep_good(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """The documents that pass every rule, with all their columns.

    A null text has no words and is rejected as too short; repeated rows get
    equal verdicts; an empty table stays empty.
    """
    order = order or order_rules(profile(docs, text_col, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch, text_col):
                yield part.filter(pa.array(passes(Texts(part.column(text_col)), order, rules)))

    return docs.mapInArrow(run, docs.schema)


MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """The base measures of every document, ``base_failed`` and the verdict ``kept``.

    The base measures are reported for all documents. The cascade, without
    the two base rules that they already decide, sees those that have not
    failed. Nulls count as empty texts; null and repeated ids are returned as
    they are; further columns are not read.
    """
    rest = {k: f for k, f in rules.items() if k not in BASE_RULES}
    order = order or order_rules(profile(docs, text_col, rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch, "text"):
                t = Texts(part.column("text"))
                words, repeats = n_words(t), n_repeat_words(t)
                base = [words, word_chars(t), n_symbols(t), line_counts(t)[:, 1].copy(), repeats]
                failed = (words < MIN_WORDS) | (100 * repeats > 30 * words)
                kept = np.zeros(len(words), dtype=bool)
                left = np.flatnonzero(~failed)
                kept[left] = passes(t.take(left), order, rest)
                columns = [*base, failed, kept]
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MEASURED)
