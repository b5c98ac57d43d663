"""Ranked lexical search with a two-level quantised index.

The index has a row for each document. Its first level holds the terms and,
for each, a byte: the term's exact integer impact in units of the term's own
step, rounded upwards. Its second level holds occurrences and the document's
length. Sums of bytes bound every score from above, and sums of bytes less one
from below, by dense products over batches of documents. A document is
rescored in whole numbers when its upper bound reaches the kth highest lower
bound of the item, so the result is exact whatever the rounding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import keep, rows_a_batch

#: Items and distinct terms of a block, at most (an item with more terms is a block of its own).
BLOCK_ITEMS, BLOCK_TERMS = 512, 200_000
#: Terms of one dense product.
SLICE = 4096
TOP = 255
FORWARD = "doc_id long, n long, terms array<int>, occurrences array<long>"
INDEX = "doc_id long, m long, terms array<int>, impacts binary, occurrences array<long>"
BOUNDS = "item int, doc_id long, m long, upper double, lower double, matched array<struct<weight: long, times: long, tf: long>>"

# Bytes of UTF-8: ASCII letters to lower case, other ASCII but digits to spaces, all others (parts of letters beyond) as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return (text or b"").translate(FOLD).split()


@dataclass
class Index:
    """``table``: a row a document with the columns of ``INDEX``; ``terms`` numbers the terms and ``weights`` are theirs."""

    table: DataFrame
    terms: dict[bytes, int]
    weights: np.ndarray


def _count(terms: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value
        for batch in batches:
            n, ids, times = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(text)
                found = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                n.append(len(words))
                ids.append([i for i, _ in found])
                times.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "occurrences"])

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def steps(weights: np.ndarray) -> np.ndarray:
    """Unit of a term's byte: the least whole number of which 255 reach the highest impact that it can have."""
    return np.maximum(1, -(-weights * 1_000_000 // TOP))


def exact_impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _quantise(weights: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            terms, sizes = flat(batch.column("terms"))
            tf, _ = flat(batch.column("occurrences"))
            m = np.repeat(batch.column("m").to_numpy(), sizes)
            impact = exact_impacts(w[terms], tf, m)
            bytes_ = (-(-impact // steps(w[terms]))).astype(np.uint8).tobytes()
            ends = np.cumsum(sizes).tolist()
            level = pa.array([bytes_[e - s : e] for e, s in zip(ends, sizes.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("m"), batch.column("terms"), level, batch.column("occurrences")], names=["doc_id", "m", "terms", "impacts", "occurrences"])

    return run


def build(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row of ``docs`` by the given terms, a bounded list; statistics are those of all rows and all their terms.

    Whole texts are read, once. A null text has no term and counts in none of
    the statistics; null and repeated ids are rows like any others.
    """
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with rows_a_batch(spark, 256):
        forward = keep(narrow.mapInArrow(_count(spark.sparkContext.broadcast(number)), FORWARD).where("n > 0"), "forward", compression="zstd")
    count, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(count) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(max(1, len(number)), dtype=np.int64)
    for term, w in df.select("term", weight).toLocalIterator():  # a row for each given term, at most
        weights[term] = w
    m = F.expr(f"25 + cast(75 as decimal(38,0)) * n * {count} div {max(1, total)}")
    with rows_a_batch(spark, 256):
        table = forward.select("doc_id", m.alias("m"), "terms", "occurrences").mapInArrow(_quantise(spark.sparkContext.broadcast(weights)), INDEX)
        return Index(keep(table, "index", compression="zstd"), number, weights)


@dataclass
class Block:
    """Items of a block as a sparse matrix by term: ``item[starts[t]:starts[t + 1]]`` hold term ``t``, ``times`` times each."""

    n: int
    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray
    terms_of: list[tuple[np.ndarray, np.ndarray]]


def block_of(items: list[Counter], terms: dict[bytes, int]) -> Block:
    cells = sorted((terms[t], i, c) for i, found in enumerate(items) for t, c in found.items())
    term, item, times = (np.array(x, dtype=np.int64) for x in zip(*cells, strict=True)) if cells else [np.zeros(0, np.int64)] * 3
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    each = [tuple(np.array(x, dtype=np.int64) for x in zip(*sorted((terms[t], c) for t, c in found.items()), strict=True)) for found in items]
    return Block(len(items), starts, item, times, each)


def sums(block: Block, unit: np.ndarray, row: np.ndarray, terms: np.ndarray, level: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of ``level`` times the term's unit over each item's terms, for every row of a batch, in products of ``SLICE`` terms."""
    known, at = np.unique(terms, return_inverse=True)
    out = np.zeros((n_rows, block.n))
    for first in range(0, len(known), SLICE):
        part = known[first : first + SLICE]
        here = (at >= first) & (at < first + SLICE)
        x = np.zeros((n_rows, len(part)))
        x[row[here], at[here] - first] = level[here]
        sizes = block.starts[part + 1] - block.starts[part]
        cell = np.arange(sizes.sum()) + np.repeat(block.starts[part] - np.cumsum(sizes) + sizes, sizes)
        q = np.zeros((len(part), block.n))
        q[np.repeat(np.arange(len(part)), sizes), block.item[cell]] = block.times[cell] * np.repeat(unit[part], sizes)
        out += x @ q
    return out


def _bounds(shared: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        unit = steps(weights).astype(float)
        best = np.zeros((k, block.n))  # the k highest lower bounds so far of each item, in this task
        for batch in batches:
            n = batch.num_rows
            terms, sizes = flat(batch.column("terms"))
            tf, _ = flat(batch.column("occurrences"))
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(n), sizes)
            level = np.frombuffer(b"".join(batch.column("impacts").to_pylist()), dtype=np.uint8)
            # sums of whole numbers, exact in doubles up to 2 ** 53: the margin covers items beyond
            upper = sums(block, unit, row, terms, level, n) * (1 + 1e-9)
            some = ((upper >= best.min(axis=0)) & (upper > 0)).any(axis=1)
            if not some.any():
                continue
            mine, place = some[row], np.cumsum(some) - 1
            lower = np.zeros_like(upper)
            lower[some] = sums(block, unit, place[row[mine]], terms[mine], level[mine] - (level[mine] > 0), int(some.sum())) * (1 - 1e-9)
            best = np.partition(np.vstack([best, lower[some]]), -k, axis=0)[-k:]
            rows, items = np.nonzero((upper >= best.min(axis=0)) & (upper > 0))
            met = []
            for r, i in zip(rows.tolist(), items.tolist(), strict=True):
                own, (wanted, times) = terms[ends[r] - sizes[r] : ends[r]], block.terms_of[i]
                spot = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                hit = own[spot] == wanted
                met.append((weights[wanted[hit]], times[hit], tf[ends[r] - sizes[r] + spot[hit]]))
            if met:
                parts = [pa.array(np.concatenate(x)) for x in zip(*met, strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in met])]).astype(np.int32))
                matched = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["weight", "times", "tf"]))
                arrays = [pa.array(items.astype(np.int32)), batch.column("doc_id").take(pa.array(rows)), batch.column("m").take(pa.array(rows)), pa.array(upper[rows, items]), pa.array(lower[rows, items]), matched]
                yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "m", "upper", "lower", "matched"])

    return run


def top(index: Index, items: list[Counter], k: int = 10) -> DataFrame:
    """``item, rank, doc_id, score``: the ``k`` best documents of each item, given by its place in the list and its terms.

    Each task keeps the kth lower bound of what it has seen, so it passes on a
    few documents for each item; the bound over all of them then decides which
    are rescored. Documents that tie with the kth are all rescored.
    """
    spark = index.table.sparkSession
    shared = spark.sparkContext.broadcast((block_of(items, index.terms), index.weights))
    with rows_a_batch(spark, 256):
        bounds = keep(index.table.mapInArrow(_bounds(shared, k), BOUNDS), "bounds", compression="zstd")
    of_item = Window.partitionBy("item")
    ranked = bounds.select("item", "lower", F.row_number().over(of_item.orderBy(F.desc("lower"))).alias("n")).where(F.col("n") <= k)
    kth = ranked.groupBy("item").agg(F.min("lower").alias("lower"), F.count(F.lit(1)).alias("n")).select("item", F.when(F.col("n") == k, F.col("lower")).otherwise(F.lit(0.0)).alias("kth"))
    reached = bounds.drop("lower").join(F.broadcast(kth), "item").where(F.col("upper") >= F.col("kth"))
    score = F.expr("aggregate(matched, 0L, (s, x) -> s + x.weight * x.times * ((1000000000L * x.tf) div (1000L * x.tf + 8L * m)))")
    scored = reached.select("item", "doc_id", score.alias("score")).where("score > 0")
    by = of_item.orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Counter(terms_of(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        terms = pa.array([list(c) for c in found], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), terms, pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])


def blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[tuple[list, list[Counter]]]:
    """Ids and terms of the items, block by block, so that the driver holds one block at a time."""
    ids, found, terms = [], [], set()
    for row in items.toLocalIterator():
        mine = Counter({bytes(t): c for t, c in zip(row.terms, row.times, strict=True)})
        if ids and (len(ids) == most_items or len(terms | mine.keys()) > most_terms):
            yield ids, found
            ids, found, terms = [], [], set()
        ids.append(row.item_id)
        found.append(mine)
        terms |= mine.keys()
    if ids:
        yield ids, found


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text", most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item its ``k`` best documents with a score above 0, equal scores by ascending id.

    Items are a stated query set. They are taken in blocks bounded in items and
    terms; the documents are indexed by the terms of a block and read whole.
    A document or item with a null or empty text has no term and appears
    nowhere, nor does an item without a match. Item rows that repeat become
    one; an id with several texts is answered for each of them. Null ids are
    rows like others and come first among equal scores; documents that repeat
    an id are ranked one by one. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id_col].dataType.simpleString()
    narrow = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    parts = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
    for ids, found in blocks(narrow.mapInArrow(_item_terms, f"item_id {kind}, terms array<binary>, times array<long>").where("size(terms) > 0"), most_items, most_terms):
        index = build(docs, sorted(set().union(*found)), id_col, text_col)
        names = spark.createDataFrame([*enumerate(ids)], f"item int, item_id {kind}")
        parts.append(top(index, found, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
