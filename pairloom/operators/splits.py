"""Leakage-free grouped folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import numbered
from ..sources.shared import keep

# Folds and their shares of the pairs.
FOLDS = {"train": 0.50, "validate": 0.30, "test": 0.20}


def primary_gene(targets: DataFrame, drugs: DataFrame) -> DataFrame:
    """``drug, group_key``: the gene of a drug's most trusted mechanism, or the drug alone."""
    order = F.struct(-F.coalesce(F.col("efficacy").cast("double"), F.lit(-1.0)), -F.coalesce(F.col("direct").cast("double"), F.lit(-1.0)), F.col("gene"))
    first = targets.where("gene is not null").groupBy("drug").agg(F.min_by("gene", order).alias("_gene"))
    key = F.coalesce(F.concat(F.lit("gene:"), F.col("_gene")), F.concat(F.lit("ing:"), F.col("drug").cast("string")))
    return drugs.select("drug").distinct().join(first, "drug", "left").select("drug", key.alias("group_key"))


def picks_above(x: np.ndarray, size: np.ndarray, so_far: np.ndarray, aim: np.ndarray, equal: bool) -> np.ndarray:
    """How many of the lacks ``(aim - (so_far + k * size)) / aim`` for k = 0, 1, 2 ... exceed ``x`` (or reach it, with ``equal``).

    They fall with k, so the number is near where the line crosses ``x``; what
    rounding leaves open is decided by the lacks themselves.
    """
    near = np.floor((aim * (1 - x) - so_far) / size)
    base = np.maximum(near - 2, 0.0)
    out = base.copy()
    for step in range(6):
        lack = (aim - (so_far + (base + step) * size)) / aim
        out += (lack >= x) if equal else (lack > x)
    return out


def nth_pick(i: np.ndarray, size: np.ndarray, so_far: np.ndarray, aims: np.ndarray) -> np.ndarray:
    """The fold that the ``i``-th group (from 0) of a class of one size goes to.

    ``so_far`` are a row's pairs in each fold before its class. Dealing groups
    of one size is a merge of each fold's falling lacks, so the i-th pick is
    the (i + 1)-th highest of them all; it is found by bisection, all rows at
    once. Of equal lacks the first fold's comes first.
    """
    folds = range(len(aims))
    high = np.full(len(i), 2.0)  # no lack is so high, and each fold has i + 1 lacks from ``low`` on
    low = np.min([(aims[f] - (so_far[:, f] + (i + 1.0) * size)) / aims[f] for f in folds], axis=0)
    for _ in range(80):
        mid = (low + high) / 2
        enough = sum(picks_above(mid, size, so_far[:, f], aims[f], True) for f in folds) > i
        low, high = np.where(enough, mid, low), np.where(enough, high, mid)
    # ``low`` is reached by more than i lacks and ``high`` is not: what lies from low up to high is the pick, or ties with it
    before = [picks_above(high, size, so_far[:, f], aims[f], True) for f in folds]
    left = i - sum(before)
    lacks = np.array([(aims[f] - (so_far[:, f] + before[f] * size)) / aims[f] for f in folds])
    order = np.argsort(-lacks, axis=0, kind="stable")
    return np.take_along_axis(order, left.astype(int)[None, :], axis=0)[0]


def class_starts(classes: list[tuple[int, int]], aims: np.ndarray) -> list[tuple[int, int, list[float]]]:
    """``size, first, so_far`` of each class ``size, members``, largest size first: its first place in the queue, and each fold's pairs before it."""
    out, so_far, first = [], np.zeros(len(aims)), 0
    for size, members in sorted(classes, reverse=True):
        out.append((size, first, so_far.tolist()))
        last = np.array([members - 1])
        n, state = np.array([float(size)]), so_far[None, :]
        # the last pick of the class, and how many picks of each fold come no later
        fold = int(nth_pick(last, n, state, aims)[0])
        taken = np.zeros(len(aims))
        lo, hi = 0, members
        while lo < hi:  # the fold's own number of picks
            k = (lo + hi) // 2
            if rank_of(fold, k, n, state, aims) < members - 1:
                lo = k + 1
            else:
                hi = k
        lack = (aims[fold] - (so_far[fold] + lo * size)) / aims[fold]
        for f in range(len(aims)):
            taken[f] = lo + 1 if f == fold else picks_above(np.array([lack]), n, state[:, f], aims[f], f < fold)[0]
        so_far = so_far + taken * size
        first += members
    return out


def rank_of(fold: int, k: int, size: np.ndarray, so_far: np.ndarray, aims: np.ndarray) -> float:
    """How many picks come before a fold's ``k``-th one."""
    lack = np.array([(aims[fold] - (so_far[0, fold] + k * size[0])) / aims[fold]])
    return k + sum(picks_above(lack, size, so_far[:, f], aims[f], f < fold)[0] for f in range(len(aims)) if f != fold)


def greedy_folds(sizes: DataFrame, seed: int = 42, folds: dict[str, float] = FOLDS) -> DataFrame:
    """``group_key, fold``: largest groups first, each to the fold that lacks most of its share.

    Equal sizes go by a hash of key and seed; of equally lacking folds the
    first wins. Each step needs the sums of all before, but groups of one size
    are dealt at once: the driver goes from size to size, of which n pairs
    have no more than sqrt(2 n), and each group finds its own fold from its
    place in its class.
    """
    names = list(folds)
    known = keep(sizes.select("group_key", "n_pairs").where("n_pairs > 0"), "sizes")
    classes = [(r.n_pairs, r["count"]) for r in known.groupBy("n_pairs").count().collect()]
    total = float(sum(n * members for n, members in classes))
    aims = np.array([share * total for share in folds.values()])
    starts = known.sparkSession.createDataFrame(class_starts(classes, aims), "n_pairs long, first long, so_far array<double>")
    ranked = numbered(known.withColumn("_hash", F.md5(F.concat("group_key", F.lit(str(seed))))), [F.col("n_pairs").desc(), F.col("_hash"), F.col("group_key")])
    placed = ranked.join(F.broadcast(starts), "n_pairs")  # a row for each size
    aims_now = aims.tolist()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                state = batch.column("so_far").flatten().to_numpy().reshape(batch.num_rows, -1)
                picked = nth_pick(batch.column("i").to_numpy(), batch.column("n").to_numpy(), state, np.array(aims_now))
                yield pa.RecordBatch.from_arrays([batch.column("group_key"), pa.array([names[f] for f in picked], pa.string())], names=["group_key", "fold"])

    rows = placed.select("group_key", (F.col("row_index") - F.col("first")).alias("i"), F.col("n_pairs").cast("double").alias("n"), "so_far")
    return rows.mapInArrow(deal, f"group_key {sizes.schema['group_key'].dataType.simpleString()}, fold string")


def class_groups(targets: DataFrame, drugs: DataFrame) -> DataFrame:
    """``drug, group_key``: the class of a drug's most trusted target that has one, or the drug alone."""
    order = F.struct(-F.coalesce(F.col("efficacy").cast("double"), F.lit(-1.0)), -F.coalesce(F.col("direct").cast("double"), F.lit(-1.0)), F.col("leaf"))
    first = targets.where("leaf is not null").groupBy("drug").agg(F.min_by("leaf", order).alias("_leaf"))
    key = F.coalesce(F.concat(F.lit("leaf:"), F.col("_leaf")), F.concat(F.lit("ing:"), F.col("drug").cast("string")))
    return drugs.select("drug").distinct().join(first, "drug", "left").select("drug", key.alias("group_key"))


def resplit(pairs: DataFrame, groups: DataFrame, folds: tuple[str, ...] = ("train", "validate"), seed: int = 42) -> DataFrame:
    """The pairs with a fold of their drug's group, by the shares of the named folds alone; an error if a drug has two."""
    total = sum(FOLDS[f] for f in folds)
    with_group = pairs.join(groups, "drug")
    sizes = with_group.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_pairs"))
    out = with_group.join(greedy_folds(sizes, seed, {f"{f}2": FOLDS[f] / total for f in folds}), "group_key")
    if not leaks(out, "drug").isEmpty():
        raise ValueError("a drug is in more than one fold")
    return out


def fold_summary(assigned: DataFrame) -> DataFrame:
    """``fold, n_pairs, share, n_drugs, n_conditions, positive_rate``."""
    every = assigned.agg(F.count(F.lit(1))).scalar()
    per = assigned.groupBy("fold").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("drug").alias("n_drugs"), F.count_distinct("condition").alias("n_conditions"), F.bround(F.avg(F.col("y").cast("double")), 4).alias("positive_rate"))
    return per.withColumn("share", F.bround(F.col("n_pairs") / every, 4))


def leaks(assigned: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one fold; empty for a sound split."""
    return assigned.groupBy(key).agg(F.count_distinct("fold").alias("n_folds")).where("n_folds > 1")


def cold_conditions(conditions: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``condition, cold``: the share of conditions, first by hash, whose pairs are held out."""
    hashed = F.md5(F.concat(F.col("condition").cast("string"), F.lit(str(seed))))
    every = conditions.agg(F.count_distinct("condition")).scalar()
    indexed = numbered(conditions.select("condition").distinct().withColumn("_hash", hashed), ["_hash", "condition"])
    return indexed.select("condition", (F.col("row_index") < F.floor(every * share)).alias("cold"))


def group_folds(groups: DataFrame, key: str = "group_key", k: int = 3) -> DataFrame:
    """``key, fold`` of a k-fold split by a hash of the group, so that it needs no order of groups."""
    place = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k))
    return groups.select(key).distinct().withColumn("fold", place.cast("int"))
