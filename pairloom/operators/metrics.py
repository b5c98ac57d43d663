"""Rank metrics by group, as window and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import numbered, prefix_sums
from ..sources.shared import keep


def average_rank(group: list[str], value: str) -> Column:
    """Rank of a value in its group, equal values sharing the mean of their ranks."""
    order = Window.partitionBy(*group).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / F.lit(2.0)


def filled_scores(scored: DataFrame, group: str, score: str) -> DataFrame:
    """NaN and null scores take their group's median; groups without any score go."""
    clean = scored.withColumn(score, F.when(~F.isnan(score), F.col(score)))
    middle = clean.groupBy(group).agg(F.percentile(score, 0.5).alias("_median")).where("_median is not null")
    return clean.join(middle, group).withColumn(score, F.coalesce(score, "_median")).drop("_median")


def group_auc(scored: DataFrame, group: str = "drug", y: str = "y", score: str = "score", min_pairs: int = 20, spread: bool = False) -> DataFrame:
    """``group, n, positives, auc`` of the groups with ``min_pairs`` rows and both classes.

    Rows of one score are counted before they are shuffled. With ``spread``
    the scores of a group are dealt over tasks by prefix sums, for few and
    large groups; else a group's distinct scores meet in one task.
    """
    filled = filled_scores(scored.where(F.col(group).isNotNull()), group, score)
    cells = filled.groupBy(group, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("long")).alias("_hits"))
    if spread:
        placed = prefix_sums(cells, group, score, {"_before": "_n"})
    else:
        below = Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    rank = F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)
    per = placed.groupBy(group).agg(F.sum("_n").alias("n"), F.sum("_hits").alias("positives"), F.sum(F.col("_hits") * rank).alias("_ranks"))
    per = per.where((F.col("n") >= min_pairs) & (F.col("positives") > 0) & (F.col("positives") < F.col("n")))
    p = F.col("positives").cast("double")
    return per.select(group, "n", "positives", ((F.col("_ranks") - p * (p + 1) / 2) / (p * (F.col("n") - p))).alias("auc"))


def macro_auc(scored: DataFrame, **options) -> DataFrame:
    return group_auc(scored, **options).agg(F.avg("auc").alias("macro_auc"), F.count(F.lit(1)).alias("n_groups"))


def at_k(scored: DataFrame, group: str = "drug", y: str = "y", score: str = "score", tie: str = "condition", precision_k: int = 10, recall_k: int = 50) -> DataFrame:
    """``group, precision, recall`` among the first k of each group; equal scores go by ``tie``."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    ranked = scored.withColumn("_row", F.row_number().over(order))
    hits = lambda k: F.sum(F.when(F.col("_row") <= k, F.col(y).cast("double")).otherwise(0.0))
    per = ranked.groupBy(group).agg(hits(precision_k).alias("_p"), hits(recall_k).alias("_r"), F.sum(F.col(y).cast("double")).alias("_all"), F.count(F.lit(1)).alias("_n"))
    return per.select(group, (F.col("_p") / F.least(F.lit(precision_k), F.col("_n"))).alias("precision"), F.when(F.col("_all") > 0, F.col("_r") / F.col("_all")).alias("recall"))


def average_precision(scored: DataFrame, group: str, y: str = "y", score: str = "score", spread: bool = False) -> DataFrame:
    """``group, average_precision``: precision at each distinct score, weighted by the recall gained there.

    With ``spread`` the scores of a group are dealt over tasks by prefix sums, for few and large groups.
    """
    steps = scored.groupBy(group, score).agg(F.sum(F.col(y).cast("double")).alias("_hits"), F.count(F.lit(1)).alias("_n"))
    if spread:
        before = prefix_sums(steps.withColumn("_down", -F.col(score)), group, "_down", {"_tp": "_hits", "_seen": "_n"})
        seen = before.withColumns({"_tp": F.col("_tp") + F.col("_hits"), "_seen": F.col("_seen") + F.col("_n")})
    else:
        down = Window.partitionBy(group).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
        seen = steps.withColumns({"_tp": F.sum("_hits").over(down), "_seen": F.sum("_n").over(down)})
    per = seen.groupBy(group).agg(F.sum(F.col("_hits") * F.col("_tp") / F.col("_seen")).alias("_sum"), F.sum("_hits").alias("_all"))
    return per.where("_all > 0").select(group, (F.col("_sum") / F.col("_all")).alias("average_precision"))


def spearman(rows: DataFrame, group: str, x: str, y: str, min_rows: int = 3) -> DataFrame:
    """``group, n, rho`` of groups with enough rows and two values or more on both sides."""
    ranked = rows.withColumns({"_x": average_rank([group], x), "_y": average_rank([group], y)})
    per = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    return per.where((F.col("n") >= min_rows) & (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))).select(group, "n", "rho")


def regression_errors(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Pearson r, R squared (1 less residual over total squares) and RMSE."""
    t, g = F.col(truth), F.col(guess)
    total = F.sum(t * t) - F.sum(t) * F.sum(t) / F.count(F.lit(1))
    return rows.agg(F.corr(truth, guess).alias("pearson"), (1 - F.sum((t - g) * (t - g)) / total).alias("r_squared"), F.sqrt(F.avg((t - g) * (t - g))).alias("rmse"))


def dense_rank(values: DataFrame, x: str) -> DataFrame:
    """``x, rank``: the distinct values of a column, numbered from 0 in order."""
    return numbered(values.where(F.col(x).isNotNull()).select(x).distinct(), [x]).withColumnRenamed("row_index", "rank")


def untied(ranks: DataFrame, x: str) -> Column:
    """Pairs of rows with unequal values."""
    sizes = ranks.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg((F.sum("_n") * F.sum("_n") - F.sum(F.col("_n") * F.col("_n"))) / 2).scalar()


def kendall_tau_b(ranks: DataFrame, item: str, x: str, y: str) -> DataFrame:
    """Tau-b of two rankings of items, of any length, without forming pairs of rows.

    Values become dense ranks. Two unequal ranks part at exactly one binary
    digit, below a common prefix; so every pair that differs in both rankings
    is counted once, in the block of its two prefixes, as a product of counts:
    rows times the square of the digits, summed by block.
    """
    ranks = keep(ranks.where(F.col(item).isNotNull()).select(x, y))
    both = ranks.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    cells = both.join(dense_rank(both, "_x").withColumnRenamed("rank", "_i"), "_x").join(dense_rank(both, "_y").withColumnRenamed("rank", "_j"), "_y")
    cells = keep(cells.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("_n")))
    digits = [int(m or 0).bit_length() for m in cells.agg(F.max("_i"), F.max("_j")).first()]  # two numbers
    at = lambda n: F.explode(F.array(*[F.lit(k) for k in range(n)]).cast("array<int>"))
    split = cells.withColumn("_k", at(digits[0])).withColumn("_l", at(digits[1]))
    above = lambda c, k: F.call_function("shiftright", c, k)
    part = {"_a": above(F.col("_i"), F.col("_k")), "_b": above(F.col("_j"), F.col("_l"))}
    split = split.withColumns(part)
    prefix = [above(F.col(c), F.lit(1)).alias(f"{c}_up") for c in part]
    low, high = [[(F.col(c) % 2) == d for c in part] for d in (0, 1)]
    n = lambda p, q: F.coalesce(F.sum(F.when(p & q, F.col("_n"))), F.lit(0))
    blocks = split.groupBy("_k", "_l", *prefix).agg((n(low[0], low[1]) * n(high[0], high[1]) - n(low[0], high[1]) * n(high[0], low[1])).alias("_s"))
    apart = F.sqrt(untied(ranks, x)) * F.sqrt(untied(ranks, y))
    return blocks.agg(F.sum("_s").alias("_s")).select((F.coalesce("_s", F.lit(0)) / F.nullif(apart, F.lit(0.0))).alias("tau"))


def calibration(scored: DataFrame, p: str, y: str, bins: int = 20) -> DataFrame:
    """Equal-width bins: ``bin, n, mean_p, mean_y``."""
    place = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1)))
    return scored.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def quantile_calibration(scored: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Bins between the quantiles of the score; equal scores share a bin."""
    edges = scored.agg(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0]  # bins - 1 numbers
    place = sum(((F.col(p) > e).cast("int") for e in edges or []), F.lit(0))
    return scored.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def slope_by_group(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(group).agg(F.regr_slope(y, x).alias("slope"))


def feature_screen(wide: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """``feature, auc, folded_auc``: how well each feature alone ranks the label; constant features are left out.

    A null or NaN takes the feature's median. Ranks come from prefix sums over
    the distinct values, as a feature has a row for each row of the table.
    """
    long = wide.unpivot([y], features, "feature", "value").select("feature", F.col(y).alias("y"), F.col("value").cast("double").alias("value"))
    cells = filled_scores(long, "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("hits"))
    ranked = prefix_sums(cells, "feature", "value", {"before": "n"})
    per = ranked.groupBy("feature").agg(F.sum("n").cast("double").alias("n"), F.sum("hits").cast("double").alias("p"), F.sum(F.col("hits") * (F.col("before") + (F.col("n") + 1) / F.lit(2.0))).alias("ranks"), F.count(F.lit(1)).alias("values"))
    p, n = F.col("p"), F.col("n")
    per = per.where((F.col("values") > 1) & (p > 0) & (p < n)).select("feature", ((F.col("ranks") - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))
    return per.select("feature", "auc", F.greatest("auc", 1 - F.col("auc")).alias("folded_auc"))


def restricted_auc(scored: DataFrame, outcomes: DataFrame, group: str = "condition", **options) -> DataFrame:
    """Per-outcome AUC over a given list of outcomes."""
    return group_auc(scored.join(outcomes, group, "left_semi"), group=group, **options)


def best_features(ranking: DataFrame, feature: str = "feature", label: str = "label", value: str = "value") -> DataFrame:
    """``label, best, agree``: the feature of the highest value under each label, and whether it is the same under all.

    Of equal values the first name wins; labels without any value have no best and no say.
    """
    known = ranking.where(F.col(value).isNotNull() & ~F.isnan(value))
    best = keep(known.groupBy(label).agg(F.min_by(feature, F.struct(-F.col(value), F.col(feature))).alias("best")), "best")
    return best.withColumn("agree", (best.agg(F.count_distinct("best")).scalar() == 1))
