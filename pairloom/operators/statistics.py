"""Floors, demeaning, bootstrap intervals, placebos, audits."""

from __future__ import annotations

import math
import re
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import numbered, prefix_sums
from ..sources.shared import keep


#: Edges are paired inside cells of about this many.
EDGES_A_CELL = 512

#: Resamples by outcome: groups that a task holds, rounds that it draws, and draws that it looks up at once, at most.
GROUPS_A_SLICE, ROUNDS_A_TASK, PLACES_A_STEP = 4_000_000, 20, 100_000


def rates(train: DataFrame, key: str = "condition", y: str = "y") -> DataFrame:
    """Flag rate of each key, over train pairs alone."""
    return train.groupBy(key).agg(F.avg(F.col(y).cast("double")).alias("p_c"))


def floor_scores(train: DataFrame, held_out: DataFrame, fallback: str = "mean") -> DataFrame:
    """Held-out pairs scored by their condition's train rate; unseen ones by the mean or median of rates, or the train prevalence."""
    table = keep(rates(train))
    other = {"mean": table.agg(F.avg("p_c")), "median": table.agg(F.percentile("p_c", 0.5)), "prevalence": train.agg(F.avg(F.col("y").cast("double")))}[fallback]
    return held_out.join(table, "condition", "left").withColumn("score", F.coalesce("p_c", other.scalar())).drop("p_c")


def demean(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``residual``: the value less its group's mean."""
    means = rows.groupBy(key).agg(F.avg(value).alias("_mean"))
    return rows.join(means, key).withColumn("residual", F.col(value) - F.col("_mean")).drop("_mean")


def variance_shares(residuals: DataFrame, key: str, value: str) -> DataFrame:
    """Share of the variance between groups and inside them."""
    return residuals.agg((1 - F.var_pop("residual") / F.var_pop(value)).alias("between"), (F.var_pop("residual") / F.var_pop(value)).alias("inside"))


def offsets(rows: DataFrame, a: str, b: str, value: str, rounds: int, tolerance: float | None) -> tuple[DataFrame, DataFrame]:
    """``a, a_offset`` and ``b, b_offset``: what alternating means take off the rows of each key.

    A key's offset is its mean less the mean of the other side's offsets over
    its rows, so a half round needs the number of rows of each pair of keys
    and the sums of each key, found once, and the other side's offsets: rows
    are neither rewritten nor read again. A pair's count is one row however
    often the pair comes. Rounds end once no offset of ``b`` moves by ``tolerance``.
    """
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = keep(known.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).cast("double").alias("_s")), "cells")
    totals = {k: keep(cells.groupBy(k).agg(F.sum("_n").alias("_rows"), F.sum("_s").alias("_sum")), "totals") for k in (a, b)}
    found = {k: totals[k].select(k, F.lit(0.0).alias(f"{k}_offset")) for k in (a, b)}
    for _ in range(rounds):
        for key, other in ((a, b), (b, a)):
            taken = cells.join(found[other], other).groupBy(key).agg(F.sum(F.col("_n") * F.col(f"{other}_offset")).alias("_taken"))
            moved = totals[key].join(taken, key).join(found[key].withColumnRenamed(f"{key}_offset", "_old"), key)
            new = keep(moved.select(key, ((F.col("_sum") - F.col("_taken")) / F.col("_rows")).alias(f"{key}_offset"), "_old"), "offsets")
            found[key] = new.drop("_old")
        # a's offsets follow from b's: once these stay, both do
        if tolerance is not None and (new.agg(F.max(F.abs(F.col(f"{b}_offset") - F.col("_old")))).first()[0] or 0.0) < tolerance:
            break
    return found[a], found[b]


def two_way_demean(rows: DataFrame, a: str, b: str, value: str, rounds: int = 4, tolerance: float | None = None) -> DataFrame:
    """Residuals of two-way fixed effects by alternating means, for a number of rounds or until no offset moves by a tolerance; rows without a key go."""
    of_a, of_b = offsets(rows, a, b, value, rounds, tolerance)
    return rows.join(of_a, a).join(of_b, b).withColumn("residual", F.col(value).cast("double") - F.col(f"{a}_offset") - F.col(f"{b}_offset")).drop(f"{a}_offset", f"{b}_offset")


def fixed_effects(train: DataFrame, a: str, b: str, value: str, rounds: int = 200, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train's two-way effects: a row with ``mean``, and tables ``a, a_offset`` and ``b, b_offset``.

    The residual of a train row is its value less the mean and both offsets.
    """
    every = keep(train.agg(F.avg(value).alias("mean")), "mean")
    centred = train.select(a, b, (F.col(value) - every.scalar()).alias("_centred"))
    return every, *offsets(centred, a, b, "_centred", rounds, tolerance)


def apply_effects(rows: DataFrame, effects: tuple[DataFrame, DataFrame, DataFrame], a: str, b: str, value: str) -> DataFrame:
    """Rows with train's offsets, never fit anew: those of an unseen key are 0 and flagged; ``residual`` is what is left."""
    mean, of_a, of_b = effects
    out = rows.join(of_a, a, "left").join(of_b, b, "left")
    for key in (a, b):
        out = out.withColumns({f"{key}_unseen": F.col(f"{key}_offset").isNull(), f"{key}_offset": F.coalesce(f"{key}_offset", F.lit(0.0))})
    return out.withColumn("residual", F.col(value) - mean.scalar() - F.col(f"{a}_offset") - F.col(f"{b}_offset"))


def draw(seed: int, n: Column, *cols: Column) -> Column:
    """A number in 0 .. n-1 from a hash of the columns."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *cols, F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), n)


def poisson_weights() -> list[int]:
    """Sums of exp(-1) / k! times 2 ** 32, rounded down, up to where nothing is left."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, 14):
        total += term
        out.append(math.floor(total * 2**32))
        term /= k
    return out


def weight(seed: int, *cols: Column) -> Column:
    """How often a resample holds a row: a Poisson number of mean 1 from a hash of the columns."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *cols, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return sum(((u >= c).cast("int") for c in poisson_weights()), F.lit(0))


def bootstrap(values: DataFrame, key: str, value: str, rounds: int = 200, seed: int = 42, quantiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """``mean, low, high``: percentile interval of the mean over resampled groups.

    Values are one per group (a drug, say). A resample gives each group a
    weight by a hash of the round and its key, so a rerun gives the same
    interval, draws are added up where the groups are, and two sums for each
    round and task are shuffled. Rounds without a group are left out.
    """
    rows = keep(values.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v")), "values")
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("round", weight(seed, F.col("round").cast("string"), F.col("key")).alias("w"), "v")
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    whole = rows.agg(F.avg("v")).scalar()
    return means.agg(F.percentile("m", quantiles[0]).alias("low"), F.percentile("m", quantiles[1]).alias("high")).select(whole.alias("mean"), "low", "high")


def paired_bootstrap(first: DataFrame, second: DataFrame, key: str, value: str, **options) -> DataFrame:
    """``mean, low, high`` of the second's gain over the first, over the groups that both have."""
    both = first.select(key, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key)
    return bootstrap(both.select(key, (F.col("_b") - F.col("_a")).alias("gain")), key, "gain", **options)


def against_floor(scored: DataFrame, floor: float, key: str, value: str, **options) -> DataFrame:
    """As ``bootstrap`` for the gain over one floor."""
    return bootstrap(scored.select(key, (F.col(value) - floor).alias("gain")), key, "gain", **options)


def _resampled(outcome: str, kind: str, rounds: int, seed: int, part: int, a_task: int):
    """Sums of the drawn values of one slice of an outcome's groups, for some of the rounds."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        name, start, first = key[0], key[1].as_py() * part, key[2].as_py() * a_task
        n = rows.column("n")[0].as_py()
        held = np.zeros(min(part, n - start))
        held[rows.column("at").to_numpy() - start] = rows.column("v").to_numpy()
        label = rows.column("label")[0].as_py()
        turns = range(first, min(first + a_task, rounds))
        sums = []
        for turn in turns:
            total = 0.0
            for i in range(0, n, PLACES_A_STEP):
                drawn = b"".join(md5(f"{label}|{turn}|{at}|{seed}".encode()).digest()[:4] for at in range(i, min(i + PLACES_A_STEP, n)))
                at = np.frombuffer(drawn, dtype=">u4").astype(np.int64) % n - start
                total += held[at[(at >= 0) & (at < len(held))]].sum()
            sums.append(total)
        return pa.table({outcome: pa.array([name.as_py()] * len(sums), name.type), "round": pa.array(turns, pa.int32()), "n": pa.array([n] * len(sums), pa.int64()), "s": pa.array(sums, pa.float64())})

    return run, f"{outcome} {kind}, round int, n long, s double"


def bootstrap_by(values: DataFrame, outcome: str, key: str, value: str, rounds: int = 200, seed: int = 42, quantiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """``outcome, n, mean, low, high``: an interval for each outcome, resampling its own groups with replacement.

    Of an outcome's n groups, n are drawn in each round, by hashes of the
    outcome, the round and the draw. A task has a slice of the groups of one
    outcome and some of the rounds, and looks its draws up there; no draw is a
    row. Outcomes of more groups than a slice hash their draws once a slice.
    """
    known = values.where(F.col(value).isNotNull() & F.col(outcome).isNotNull()).select(outcome, F.col(key).alias("key"), F.col(value).cast("double").alias("v"), F.lit(1).alias("_one"))
    rows = keep(prefix_sums(known, outcome, "key", {"at": "_one"}).select(outcome, "v", F.col("at").cast("long").alias("at")), "placed")
    sizes = rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    parts = -(-rounds // ROUNDS_A_TASK)
    dealt = rows.join(sizes.select(outcome, "n"), outcome).withColumns({"_part": F.floor(F.col("at") / GROUPS_A_SLICE).cast("int"), "_turns": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "label": F.col(outcome).cast("string")})
    run, schema = _resampled(outcome, values.schema[outcome].dataType.simpleString(), rounds, seed, GROUPS_A_SLICE, ROUNDS_A_TASK)
    cells = max(1, sizes.agg(F.sum(F.ceil(F.col("n") / GROUPS_A_SLICE))).first()[0] or 0) * parts
    sums = dealt.repartition(min(cells, 4096), outcome, "_part", "_turns").groupBy(outcome, "_part", "_turns").applyInArrow(run, schema)
    means = sums.groupBy(outcome, "round").agg((F.sum("s") / F.first("n")).alias("m"))
    ends = means.groupBy(outcome).agg(F.percentile("m", quantiles[0]).alias("low"), F.percentile("m", quantiles[1]).alias("high"))
    return sizes.join(ends, outcome)


def slope(n: Column, x: Column, y: Column, xx: Column, xy: Column) -> Column:
    """Least-squares slope from sums; null where x has one value."""
    spread = n * xx - x * x
    return F.when(spread > 1e-12 * F.abs(n * xx), (n * xy - x * y) / spread)


def slope_interval(values: DataFrame, key: str, x: str, y: str, rounds: int = 1000, seed: int = 0, quantiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """``n, slope, low, high``: the slope of y on x over groups, and its percentile interval over resampled groups.

    A resample gives each group a weight by a hash of the round and its key,
    and its slope comes from weighted sums. So draws are added up where the
    groups are, and only a row of sums for each round and task is shuffled.
    Rounds whose groups share one x have no slope and are left out; groups
    without an x or y as well.
    """
    rows = keep(values.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "slopes")
    one = rows.select(F.lit(1.0).alias("w"), "x", "y")
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("round", weight(seed, F.col("round").cast("string"), F.col("key")).cast("double").alias("w"), "x", "y")
    w = F.col("w")
    sums = [F.sum(w).alias("n"), F.sum(w * F.col("x")).alias("x"), F.sum(w * F.col("y")).alias("y"), F.sum(w * F.col("x") * F.col("x")).alias("xx"), F.sum(w * F.col("x") * F.col("y")).alias("xy")]
    found = slope(*[F.col(c) for c in ("n", "x", "y", "xx", "xy")])
    point = keep(one.agg(*sums).select(F.col("n").cast("long").alias("n"), found.alias("slope")), "slope")  # one row
    ends = drawn.groupBy("round").agg(*sums).select(found.alias("s")).agg(F.percentile("s", quantiles[0]).alias("low"), F.percentile("s", quantiles[1]).alias("high"))
    return ends.select(point.select("n").scalar().alias("n"), point.select("slope").scalar().alias("slope"), "low", "high")


def permuted(rows: DataFrame, group: str, key: str, value: str, seed: int = 42) -> DataFrame:
    """Placebo: the values of each group dealt anew among its rows."""
    there = Window.partitionBy(group).orderBy(key)
    mixed = Window.partitionBy(group).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key)
    places = rows.withColumn("_at", F.row_number().over(there))
    values = rows.select(F.col(group), F.col(value).alias("placebo"), F.row_number().over(mixed).alias("_at"))
    return places.join(values, [group, "_at"]).drop("_at")


def swap_edges(edges: DataFrame, a: str, b: str, seed: int = 42, rounds: int = 4) -> DataFrame:
    """Placebo: edges rewired with every node's degree kept.

    In each round edges are paired by a hash and exchange their ends where
    that makes no edge twice. All pairs of a round are tested at once against
    the edges of the round and each other, so it is a join, not a chain.
    """
    now = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    cells = max(1, now.count() // EDGES_A_CELL)
    for turn in range(rounds):
        hashed = F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.lit(f"{seed}:{turn}")))
        numbered = now.withColumns({"_h": hashed, "_cell": F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(cells))}).withColumn("_n", F.row_number().over(Window.partitionBy("_cell").orderBy("_h")))
        mates = numbered.withColumn("_pair", F.floor((F.col("_n") + 1) / 2)).groupBy("_cell", "_pair").agg(F.sort_array(F.collect_list(F.struct("_h", "a", "b"))).alias("e"))
        first, second = F.col("e")[0], F.get("e", F.lit(1))
        swapped = F.array(F.struct(first["a"].alias("a"), second["b"].alias("b")), F.struct(second["a"].alias("a"), first["b"].alias("b")))
        same = F.array(*[F.struct(x["a"].alias("a"), x["b"].alias("b")) for x in (first, second)])
        tried = mates.where(F.size("e") == 2).select("_cell", "_pair", same.alias("old"), swapped.alias("new"))
        new = tried.select("_cell", "_pair", F.explode("new").alias("n")).select("_cell", "_pair", "n.a", "n.b")
        clash = new.join(now, ["a", "b"], "left_semi").select("_cell", "_pair")
        twice = new.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("a", "b"))).where("_times > 1").select("_cell", "_pair")
        good = tried.join(clash.unionByName(twice).distinct(), ["_cell", "_pair"], "left_anti")
        gone = good.select(F.explode("old").alias("x")).select("x.a", "x.b")
        come = good.select(F.explode("new").alias("x")).select("x.a", "x.b")
        now = keep(now.join(gone, ["a", "b"], "left_anti").unionByName(come))
    return now.select(F.col("a").alias(a), F.col("b").alias(b))


def forbidden(columns: list[str], exact: tuple[str, ...], prefixes: tuple[str, ...]) -> list[str]:
    """Columns that must not be features, by name or prefix."""
    return [c for c in columns if c in exact or c.startswith(prefixes)]


def increments(results: DataFrame, order: str, metric: str, noise: float = 0.01) -> DataFrame:
    """Gain of each design over the one before, and whether it is within the noise."""
    over = Window.orderBy(order)  # a row for each design
    out = results.withColumn("increment", F.col(metric) - F.lag(metric).over(over))
    return out.withColumn("is_noise", F.abs("increment") < noise)


def dictionary(df: DataFrame, table: str, spec: dict[str, str] | None = None, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """``table, column, type, share_present`` and, with a spec, ``description``: one pass over the table.

    A column is described by its name, else by the first pattern that matches
    all of it; with a spec, a column that neither knows is an error.
    """
    described = {c: (spec or {}).get(c) or next((text for p, text in patterns or [] if re.fullmatch(p, c)), None) for c in df.columns}
    unknown = [c for c, text in described.items() if text is None]
    if spec is not None and unknown:
        raise ValueError(f"no description of {', '.join(unknown)} in {table}")
    kinds = dict(df.dtypes)
    present = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = present.unpivot(["_n"], [f"`{c}`" for c in df.columns], "column", "present")
    named = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])[F.col("column")]
    out = long.select(F.lit(table).alias("table"), "column", named(kinds).alias("type"), F.bround(F.col("present") / F.col("_n"), 4).alias("share_present"))
    return out if spec is None else out.withColumn("description", named(described))
