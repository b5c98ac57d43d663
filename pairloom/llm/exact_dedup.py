"""Exact dedup by a tree-merge of sorted digest runs.

The digests of all texts are written once, each with its lane, a number that
its place in the input gives it. A lane's digests, sorted, are its run, with one
row for each digest: the id that stays and the number of rows. There are
``radix ** rounds`` lanes. In round k the lanes whose numbers differ only in
digit k exchange their runs (two lanes for radix 2, a binomial exchange):
a digest moves to the lane whose digit k is the digest's. The pieces of runs
that meet in a lane are merged in order of digest, and equal neighbours
become one row with the larger id and the sum of the counts. After the last
round a digest has one row, in the lane that its digits name.

A digest that a third of all rows hold has at most one row for each lane
before the first exchange and ``radix`` times fewer after each, so no task
ever gathers a group of copies. The lanes bring the verdicts back: a lane's
run looks up the merged rows by digest, and the documents look up their own
lane's run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh, keep

RADIX = 2
#: Rounds of exchange, at least: 16 lanes for radix 2.
LEAST_ROUNDS = 4
#: Lanes are so many that one has about this many documents, radix to a whole power.
LANE_ROWS = 1 << 20
#: Digests are equal when all of this is: SHA-256, length and a second hash.
KEY = ("digest", "length", "check")


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest, length, check, second, part, place``: one pass over the texts; ``place`` is the row's in its input partition."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("length"), F.xxhash64(text).alias("check"), F.xxhash64(F.lit(7), text).alias("second"), F.spark_partition_id().alias("part"), place.alias("place"))


def same_as_next(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """For all rows but the last, whether the next one has the same digest, length and check."""
    digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
    same = (digest[1:] == digest[:-1]).all(axis=1)
    for name in KEY[1:]:
        x = batch.column(name).to_numpy()
        same &= x[1:] == x[:-1]
    return same


def merge_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a sorted stream: of rows with one digest the last, which has the largest id, stays with the sum of their counts."""
    held = None  # the last digest so far, as its group may go on in the next batch
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        ends = np.append(np.flatnonzero(~same_as_next(batch)), batch.num_rows - 1)
        counts = np.add.reduceat(batch.column("n").to_numpy(), np.append(0, ends[:-1] + 1))
        merged = batch.take(pa.array(ends))
        merged = pa.RecordBatch.from_arrays([pa.array(counts) if f.name == "n" else merged.column(f.name) for f in batch.schema], schema=batch.schema)
        held = merged.slice(merged.num_rows - 1)
        yield merged.slice(0, merged.num_rows - 1)
    if held is not None:
        yield held


def run_of_lanes(rows: DataFrame, lanes: int) -> DataFrame:
    """Bring each lane's rows to a task of its own, sort them there and merge equal ones."""
    there = rows.repartitionById(lanes, "lane").sortWithinPartitions(*KEY, F.col("doc_id").asc_nulls_first(), "home")
    return there.mapInArrow(merge_run, rows.schema)


def digit(x: Column, k: int, radix: int) -> Column:
    return F.pmod(F.floor(x / radix**k), F.lit(radix))


def exchange(runs: DataFrame, k: int, radix: int, rounds: int) -> DataFrame:
    """Round k: a digest's row moves to the lane whose digit k is the digest's; the other digits of its lane stay."""
    wanted = digit(F.pmod(F.col("check"), F.lit(radix**rounds)), k, radix)
    moved = F.col("lane") + (wanted - digit(F.col("lane"), k, radix)) * radix**k
    return run_of_lanes(runs.withColumn("lane", moved.cast("int")), radix**rounds)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX, lane_rows: int = LANE_ROWS) -> DataFrame:
    """``doc_id, digest, length, check, second, keep_id, group_size, kept`` for every row of ``docs``."""
    digests = keep(digested(docs, id_col, text_col), "digests")
    total, rounds = digests.count(), LEAST_ROUNDS if radix == RADIX else 1
    while radix**rounds * lane_rows < total:
        rounds += 1
    # a partition of many rows is dealt over lanes
    lane = F.pmod(F.col("part") + F.floor(F.col("place") / lane_rows), F.lit(radix**rounds)).cast("int")
    rows = digests.withColumn("lane", lane).drop("part", "place")
    # what a task reads of a lane is merged before it moves
    first = rows.select("doc_id", *KEY, "lane", F.col("lane").alias("home"), F.lit(1).cast("long").alias("n"))
    first = first.sortWithinPartitions("lane", *KEY, F.col("doc_id").asc_nulls_first()).mapInArrow(merge_lane_pieces, first.schema)
    runs = keep(run_of_lanes(first, radix**rounds), "runs")
    merged = runs
    for k in range(rounds):
        merged = exchange(merged, k, radix, rounds)
    merged = merged.select(*KEY, F.col("doc_id").alias("keep_id"), F.col("home").alias("_home"), F.col("n").alias("group_size"))
    # one row for each lane and digest on the left, one for each digest on the right
    verdicts = runs.select("lane", *KEY).join(merged, list(KEY))
    same_id = Window.partitionBy("lane", *KEY).orderBy(F.col("doc_id").desc_nulls_last())
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("lane") == F.col("_home")) & (F.col("_nth") == 1)
    return rows.join(verdicts, ["lane", *KEY]).withColumn("_nth", F.row_number().over(same_id)).select("doc_id", *KEY, "second", "keep_id", "group_size", stays.alias("kept"))


def merge_lane_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``merge_run`` for rows sorted by lane first: a lane's rows end where the next one's begin."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            lanes = batch.column("lane").to_numpy()
            cuts = [0, *(np.flatnonzero(lanes[1:] != lanes[:-1]) + 1), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    yield int(lanes[lo]), batch.slice(lo, hi - lo)

    from itertools import groupby

    for _, lane in groupby(pieces(), key=lambda p: p[0]):
        yield from merge_run(batch for _, batch in lane)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX, lane_rows: int = LANE_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as the empty text. The row
    with the largest id of a group stays. Of repeated rows with that id and
    text exactly one has ``kept``. A null id loses to any other; a group of
    null ids alone has a null ``keep_id`` and keeps one row. Further columns
    of the input are neither read nor returned; an empty table gives no rows.
    """
    return mark(docs, id_col, text_col, radix, lane_rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX, lane_rows: int = LANE_ROWS) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    Rows that repeat an id and its text become one of them; where their other
    columns differ, any one. Repeated rows meet in each task before anything
    moves, and the verdicts are narrow, so texts are moved once.
    """
    a, b = fresh("_a", docs.columns), fresh("_b", docs.columns)

    def names(df: DataFrame, id_col: str, *hashes: Column) -> DataFrame:
        return df.withColumns({a: F.xxhash64(F.lit(1), F.col(id_col), *hashes), b: F.xxhash64(F.lit(2), *hashes, F.col(id_col))})

    kept = names(mark(docs, id_col, text_col, radix, lane_rows).where("kept").select("doc_id", *KEY[1:], "second"), "doc_id", *map(F.col, (*KEY[1:], "second"))).select(a, b)
    text = F.coalesce(F.col(text_col), F.lit(""))
    once = names(docs, id_col, F.octet_length(text), F.xxhash64(text), F.xxhash64(F.lit(7), text)).dropDuplicates([a, b])
    return once.join(kept, [a, b], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
