"""Learners over pair features: fits, scores out of fold, importances, and placebos by ablation.

The estimators are MLlib's; none is bit-compatible with other libraries. What
is fixed here is what surrounds them: medians of train rows alone, folds that
never part a group, one model scored over masked copies of its features in one
pass, refits inside a subset with their noise over seeds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import keep
from . import metrics as R
from .splits import group_folds
from .statistics import rates

# Size of the boosted models and of the forests.
ROUNDS, STEP, DEPTH, BINS, LEAST_ROWS = 200, 0.06, 6, 255, 20
TREES, FOREST_DEPTH, FOREST_LEAST_ROWS = 300, 14, 2
MOST_GAP = 0.15
#: Rows of a partition that a model is fitted on, where the cluster has cores for as many partitions.
ROWS_A_PART = 100_000
#: Rows from which equal ones are fitted as one row with a weight.
GROUPED_FROM = 100_000


def logistic(seed: int = 0) -> LogisticRegression:
    return LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=1000)


def boosted(seed: int = 0, rounds: int | None = None, depth: int = DEPTH, share: float = 1.0) -> GBTClassifier:
    """Boosted trees of 2 ** ``depth`` leaves at most; ``share`` of the rows is drawn for each tree, by the seed."""
    return GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds or ROUNDS, stepSize=STEP, maxDepth=depth, maxBins=BINS, minInstancesPerNode=LEAST_ROWS, subsamplingRate=share, seed=seed)


def linear(seed: int = 0) -> LinearRegression:
    return LinearRegression(featuresCol="_x", labelCol="_y")


def boosted_regression(seed: int = 0, rounds: int | None = None, depth: int = DEPTH, share: float = 1.0) -> GBTRegressor:
    return GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=rounds or ROUNDS, stepSize=STEP, maxDepth=depth, maxBins=BINS, minInstancesPerNode=LEAST_ROWS, subsamplingRate=share, seed=seed)


def forest(seed: int = 0, trees: int | None = None, depth: int = FOREST_DEPTH) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees or TREES, maxDepth=depth, minInstancesPerNode=FOREST_LEAST_ROWS, maxBins=BINS, seed=seed)


def number(c: str) -> Column:
    """A feature as a double; NaN is missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass
class Fitted:
    """A model with what its features' gaps are filled with; without a model every score is ``constant``."""

    features: list[str]
    medians: list[float]
    model: Model | None
    constant: float | None = None

    def values(self) -> Column:
        """The features of a row as an array, gaps filled."""
        return F.array(*[F.coalesce(number(f), F.lit(m)) for f, m in zip(self.features, self.medians, strict=True)])

    def score(self, rows: DataFrame, into: str = "score", values: Column | None = None) -> DataFrame:
        """``rows`` with the probability of label 1, or with the value that a regression gives; a column ``into`` is replaced."""
        if self.model is None:
            return rows.withColumn(into, F.lit(self.constant).cast("double"))
        told = self.model.transform(rows.withColumn("_x", array_to_vector(self.values() if values is None else values)))
        p = vector_to_array("probability")[1] if "probability" in told.columns else F.col("prediction")
        return told.withColumn(into, p).select(*[c for c in rows.columns if c != into], into)

    def importances(self, most: int = 25) -> list[tuple[int, str, float]]:
        """``rank, feature, gain``: the features that lessen the loss most; gains add up to 1."""
        gains = self.model.featureImportances.toArray().tolist() if self.model is not None else [0.0] * len(self.features)
        return [(k + 1, f, g) for k, (g, f) in enumerate(sorted(zip(gains, self.features, strict=True), key=lambda x: (-x[0], x[1]))[:most])]


def weighted(model, n: int):
    """The learner for rows that stand for several, of ``n`` in all; None where it draws rows one by one."""
    if model.hasParam("subsamplingRate"):
        if isinstance(model, RandomForestRegressor) or model.getSubsamplingRate() < 1.0:
            return None
        # the least rows of a node, as a share of the weight of all
        model.setMinInstancesPerNode(1).setMinWeightFractionPerNode((LEAST_ROWS - 0.5) / n)
    return model.setWeightCol("_w")


def fit(train: DataFrame, features: list[str], label: str, learner: Callable = boosted, **options) -> Fitted:
    """Fit a learner on rows whose label is known.

    Missing features take the median of these rows, 0 where a feature has no
    value at all. Where a classifier would see one class only, or a regression
    no row, the score is the labels' mean (null without rows).

    Of many rows, equal ones are fitted as one row with their number as its
    weight, unless the learner draws rows. Partitions are no more than the
    cluster's cores: each step of a fit sends something to the driver from
    every one of them.
    """
    rows = train.where(F.col(label).isNotNull()).select(*[number(f).alias(f"_f{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("_y"))
    middles = [F.coalesce(F.percentile_approx(f"_f{k}", 0.5), F.lit(0.0)) for k in range(len(features))]
    n, mean, low, high, *medians = rows.agg(F.count(F.lit(1)), F.avg("_y"), F.min("_y"), F.max("_y"), *middles).first()
    model = learner(**options)
    if not n or low == high:
        return Fitted(features, medians, None, mean)
    filled = F.array(*[F.coalesce(f"_f{k}", F.lit(m)) for k, m in enumerate(medians)])
    cores = train.sparkSession.sparkContext.defaultParallelism
    alike = weighted(learner(**options), n) if n > GROUPED_FROM else None
    if alike is None:
        vectors = rows.select(array_to_vector(filled).alias("_x"), "_y").repartition(min(-(-n // ROWS_A_PART), cores))
        return Fitted(features, medians, model.fit(vectors))
    grouped = keep(rows.select(filled.alias("_v"), "_y").groupBy("_v", "_y").agg(F.count(F.lit(1)).cast("double").alias("_w")), "weighted")
    vectors = grouped.select(array_to_vector("_v").alias("_x"), "_y", "_w").repartition(min(-(-grouped.count() // ROWS_A_PART), cores))
    return Fitted(features, medians, alike.fit(vectors))


def at_once(spark: SparkSession, jobs: list[Callable]) -> list:
    """Run jobs side by side, as each leaves most of a cluster idle between its small steps."""
    with ThreadPool(max(1, len(jobs))) as pool:
        return [found.get() for found in [pool.apply_async(inheritable_thread_target(spark)(job)) for job in jobs]]


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str, learner: Callable = boosted, k: int = 3, **options) -> DataFrame:
    """``rows`` with ``fold`` and ``score``: every row scored by the model that saw no row of its group.

    Folds go by a hash of the group, so groups are never parted; a row without
    a group is in none and goes. The fits of the folds run side by side.
    """
    table = keep(rows.join(group_folds(rows.where(F.col(group).isNotNull()), group, k), group), "folds")
    fits = at_once(rows.sparkSession, [lambda f=f: fit(table.where(F.col("fold") != f), features, label, learner, **options) for f in range(k)])
    return reduce(DataFrame.unionByName, [fits[f].score(table.where(F.col("fold") == f)) for f in range(k)])


def fold_precision(scored: DataFrame, label: str = "y") -> DataFrame:
    """``fold, n, positives, average_precision`` of scores out of fold; null where a fold has no positive."""
    per = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    return per.join(R.average_precision(scored, "fold", label, spread=True), "fold", "left")


def degree_features(train: DataFrame, rows: DataFrame, label: str = "y", drug: str = "drug", condition: str = "condition") -> DataFrame:
    """``rows`` with what train alone says of both sides: ``log_drug_degree``, ``log_condition_degree`` and ``p_c``.

    A drug or condition that train lacks takes the median degree; a condition
    without a rate takes the mean of all rates.
    """
    table = keep(train.select(drug, condition, label), "train")
    out = rows
    for key, name in ((drug, "log_drug_degree"), (condition, "log_condition_degree")):
        sizes = keep(table.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "degrees")
        middle = sizes.agg(F.percentile("_n", 0.5)).scalar()
        out = out.join(sizes, key, "left").withColumn(name, F.log1p(F.coalesce(F.col("_n").cast("double"), middle))).drop("_n")
    known = keep(rates(table, condition, label), "rates")
    return out.join(known, condition, "left").withColumn("p_c", F.coalesce("p_c", known.agg(F.avg("p_c")).scalar()))


DEGREES = ["log_drug_degree", "log_condition_degree", "p_c"]


def learned_floor(train: DataFrame, held_out: DataFrame, label: str = "y", min_pairs: tuple[int, ...] = (5, 20), learner: Callable = boosted, **options) -> DataFrame:
    """``min_pairs, floor_pc, floor_degree_pc, prevalence, n_drugs_scored``: what degrees and rates alone reach.

    ``floor_pc`` ranks held-out pairs by their condition's train rate,
    ``floor_degree_pc`` by a model on both degrees and that rate. Both are the
    mean AUC of drugs with ``min_pairs`` pairs and both classes.
    """
    model = fit(degree_features(train, train, label), DEGREES, label, learner, **options)
    scored = keep(model.score(degree_features(train, held_out, label)).select("drug", F.col(label).alias("y"), "p_c", "score"), "floor")
    prevalence = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    rows = []
    for least in min_pairs:
        pc = R.macro_auc(scored, score="p_c", min_pairs=least).select(F.col("macro_auc").alias("floor_pc"))
        both = R.macro_auc(scored, min_pairs=least).select(F.lit(least).alias("min_pairs"), F.col("macro_auc").alias("floor_degree_pc"), F.col("n_groups").alias("n_drugs_scored"))
        rows.append(both.withColumns({"floor_pc": pc.scalar(), "prevalence": prevalence}))  # a row each
    return reduce(DataFrame.unionByName, rows).select("min_pairs", "floor_pc", "floor_degree_pc", "prevalence", "n_drugs_scored")


def mean_score(fits: list[Fitted], rows: DataFrame, values: str) -> DataFrame:
    """``rows`` with the mean score of models that share their features, read from an array column."""
    names = [f"_score{k}" for k in range(len(fits))]
    out = rows
    for name, model in zip(names, fits, strict=True):
        out = model.score(out, name, F.col(values))
    return out.withColumn("score", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).select(*rows.columns, "score")


def zeroed(values: Column, at: int) -> Column:
    return F.transform(values, lambda v, i: F.when(i == at, F.lit(0.0)).otherwise(v))


def zeroed_margins(train: DataFrame, held_out: DataFrame, features: list[str], tested: list[str], label: str = "y", group: str = "drug", by: str | None = None, seeds: tuple[int, ...] = (0, 1, 2), min_pairs: int = 20, learner: Callable = boosted, **options) -> DataFrame:
    """``feature, n_groups, auc, zeroed_auc, margin`` (and ``by``): what each tested feature adds inside one fitted model.

    A refit without a feature changes all trees, so its gain is no measure of
    the feature. Here models of several seeds are fitted once, and every
    held-out row is scored as it is and with each tested feature set to 0, as
    copies of its vector in one pass. Where a feature is 0 anyway both scores
    agree by construction, and so do their AUCs.
    """
    fits = at_once(train.sparkSession, [lambda s=s: fit(train, features, label, learner, seed=s, **options) for s in seeds])
    copies = [F.struct(F.lit(None).cast("string").alias("feature"), F.col("_v").alias("_v"))]
    copies += [F.struct(F.lit(f).alias("feature"), zeroed(F.col("_v"), features.index(f)).alias("_v")) for f in tested]
    names = [by] if by else []
    rows = held_out.select(group, *names, F.col(label).alias("y"), fits[0].values().alias("_v"))
    copied = rows.withColumn("_copy", F.explode(F.array(*copies))).select(group, *names, "y", "_copy.feature", "_copy._v")
    scored = keep(mean_score(fits, copied, "_v").select(F.struct("feature", *names, group).alias("_key"), "y", "score"), "masked")
    per = R.group_auc(scored, "_key", min_pairs=min_pairs).select("_key.*", "auc")
    whole = per.where("feature is null").drop("feature")
    met = per.where("feature is not null").withColumnRenamed("auc", "_zeroed").join(whole, [*names, group])
    return met.groupBy("feature", *names).agg(F.count(F.lit(1)).alias("n_groups"), F.avg("auc").alias("auc"), F.avg("_zeroed").alias("zeroed_auc"), F.avg(F.col("auc") - F.col("_zeroed")).alias("margin"))


def refit_gains(train: DataFrame, held_out: DataFrame, base: list[str], tested: str, label: str = "y", seeds: tuple[int, ...] = (0, 1, 2), share: float = 0.8, min_pairs: int = 20, min_rows: int = 50, learner: Callable = boosted, **options) -> DataFrame:
    """``seed, n_train, n_held_out, base_auc, auc, gain``: both designs fitted inside a subset of the rows, for each seed.

    Placebo: in a subset where the tested feature is constant the designs are
    the same, so the gains show the noise of refitting (each tree sees
    ``share`` of the rows, drawn by the seed). Of too small or one-sided
    subsets the figures are null.
    """
    inside = keep(train.select(label, *base, tested), "subset")
    n, low, high = inside.agg(F.count(F.lit(1)), F.min(label), F.max(label)).first()
    every = held_out.count()
    spark = train.sparkSession
    schema = "seed int, n_train long, n_held_out long, base_auc double, auc double, gain double"
    if n < min_rows or low == high:
        return spark.createDataFrame([(s, n, every, None, None, None) for s in seeds], schema)

    def auc(features: list[str], seed: int) -> float | None:
        scored = fit(inside, features, label, learner, seed=seed, share=share, **options).score(held_out)
        return R.macro_auc(scored.select("drug", F.col(label).alias("y"), "score"), min_pairs=min_pairs).first()[0]

    found = at_once(spark, [lambda f=f, s=s: auc(f, s) for s in seeds for f in (base, [*base, tested])])
    pairs = list(zip(seeds, found[::2], found[1::2], strict=True))
    return spark.createDataFrame([(s, n, every, a, b, None if a is None or b is None else b - a) for s, a, b in pairs], schema)


def gap(train_metric: Column, held_out_metric: Column, most: float = MOST_GAP) -> Column:
    """Whether train exceeds held-out rows by more than ``most``: a model that fits too closely, or a leaked feature."""
    return F.coalesce(train_metric - held_out_metric > most, F.lit(False))


def check_gap(train_metric: float, held_out_metric: float, most: float = MOST_GAP) -> None:
    """An error where ``gap`` holds."""
    if train_metric - held_out_metric > most:
        raise ValueError(f"train exceeds held-out rows by {train_metric - held_out_metric:.4f}, more than {most:.4f}")
