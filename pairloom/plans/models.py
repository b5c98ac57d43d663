"""Queries of learners: out-of-fold scores, floors, importances, ablations. None has SQL, as fits are not bit-reproducible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learners as M
from ..operators import metrics as R
from ..operators import network as N
from ..operators import splits as S
from ..operators import statistics as T
from ..sources.shared import keep
from . import base as B
from .base import r6

QUERIES: dict = {}
ORACLES: dict = {}

FEATURES = [*M.DEGREES, "score", "gene_overlap", "nothing"]
#: Rounds of the queries that fit many models; ``gbt_floor`` and ``grouped_cv`` have the full number.
FEWER_ROUNDS = 40


def query(f):
    QUERIES[f.__name__] = f
    return f


def designs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Train and held-out pairs with their features, of which degrees and rates are train's alone; ``nothing`` is 0 throughout."""
    pairs = keep(B.scored(spark, d), "scored")
    overlap = N.overlap(pairs.select("drug", "condition"), B.drug_genes(spark, d), B.condition_genes(spark, d), "gene", "score")
    groups = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("group_key"))
    wide = pairs.join(overlap.select("drug", "condition", F.col("jaccard").alias("gene_overlap")), ["drug", "condition"]).join(groups, "drug").withColumn("nothing", F.lit(0.0))
    inside = B.train_drugs(spark, d)
    train = keep(wide.join(inside, "drug", "left_semi"), "train")
    return tuple(keep(M.degree_features(train, rows), "design") for rows in (train, wide.join(inside, "drug", "left_anti")))


@query
def gbt_floor(spark: SparkSession, d: str) -> DataFrame:
    """Held-out AUC of the rate alone and of a learned floor on degrees and the rate, at two eligibilities."""
    pairs, inside = keep(B.scored(spark, d), "scored"), B.train_drugs(spark, d)
    out = M.learned_floor(pairs.join(inside, "drug", "left_semi"), pairs.join(inside, "drug", "left_anti"))
    return out.select("min_pairs", *[r6(F.col(c)).alias(c) for c in ("floor_pc", "floor_degree_pc", "prevalence")], "n_drugs_scored")


@query
def grouped_cv(spark: SparkSession, d: str) -> DataFrame:
    """Average precision out of fold, group by group, of a logistic and a boosted model."""
    train, _ = designs(spark, d)
    parts = []
    for name, learner in (("logistic", M.logistic), ("boosted", M.boosted)):
        scored = M.out_of_fold(train, FEATURES, "y", "group_key", learner)
        parts.append(M.fold_precision(scored).select(F.lit(name).alias("model"), "fold", "n", "positives", r6(F.col("average_precision")).alias("average_precision")))
    return reduce(DataFrame.unionByName, parts)


@query
def residual_learners(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold errors of three regressions of a pair's cases."""
    train, _ = designs(spark, d)
    features, parts = [f for f in FEATURES if f != "score"], []
    for name, learner, options in (("linear", M.linear, {}), ("boosted", M.boosted_regression, {"rounds": min(FEWER_ROUNDS, M.ROUNDS)}), ("forest", M.forest, {"trees": min(60, M.TREES)})):
        scored = keep(M.out_of_fold(train, features, "case_count", "group_key", learner, **options).select(F.lit(1).alias("all"), F.col("case_count").cast("double").alias("truth"), "score"), "regressed")
        errors = R.regression_errors(scored, "truth", "score").select(F.lit(name).alias("model"), *[r6(F.col(c)).alias(c) for c in ("pearson", "r_squared", "rmse")])
        parts.append(errors)
    return reduce(DataFrame.unionByName, parts)


@query
def gain_importance(spark: SparkSession, d: str) -> DataFrame:
    """Features of a boosted model by their share of the gain."""
    train, _ = designs(spark, d)
    found = M.fit(train, FEATURES, "y", M.boosted, rounds=min(FEWER_ROUNDS, M.ROUNDS)).importances()
    return spark.createDataFrame(found, "rank int, feature string, gain double").withColumn("gain", r6(F.col("gain")))


@query
def zeroed_features(spark: SparkSession, d: str) -> DataFrame:
    """What each feature adds inside one model, by strata of the held-out drugs; ``nothing`` adds nothing."""
    train, held_out = designs(spark, d)
    rows = held_out.withColumn("stratum", F.when(F.col("drug") % 2 == 0, "even").otherwise("odd"))
    out = M.zeroed_margins(train, rows, FEATURES, ["p_c", "score", "gene_overlap", "nothing"], by="stratum", seeds=(0, 1), share=0.8, rounds=min(FEWER_ROUNDS, M.ROUNDS))
    return out.select("feature", "stratum", "n_groups", *[r6(F.col(c)).alias(c) for c in ("auc", "zeroed_auc", "margin")])


@query
def refit_in_subset(spark: SparkSession, d: str) -> DataFrame:
    """Gain of a score that only even drugs have, among odd drugs, where it is 0 throughout: the noise of refitting, by seed."""
    even = F.when(F.col("drug") % 2 == 0, F.col("score")).otherwise(F.lit(0.0))
    train, held_out = (rows.withColumn("even_score", even).where("drug % 2 = 1") for rows in designs(spark, d))
    out = M.refit_gains(train, held_out, ["log_condition_degree", "p_c", "score"], "even_score", seeds=(0, 1), rounds=min(FEWER_ROUNDS, M.ROUNDS), min_pairs=5)
    return out.select("seed", "n_train", "n_held_out", *[r6(F.col(c)).alias(c) for c in ("base_auc", "auc", "gain")])


#: Features of the designs that copy labels, that know none, and of both together.
COPYING, FREE = ["rate", "excess", "p_c"], ["n_shared", "sum_weight", "jaccard"]


@query
def split_unions(spark: SparkSession, d: str) -> DataFrame:
    """Models on label copies, on label-free features and on both, on the split by drugs and the one by conditions.

    All features are found anew from each split's train pairs; a leak audit of
    their names guards the label-free ones.
    """
    if T.forbidden(FREE, ("y", "p_c", "prr", "rate", "excess"), ("faers_", "n_flagged")):
        raise ValueError("a label-free design holds a label")
    pairs = keep(B.scored(spark, d).select("drug", "condition", "y"), "scored")
    genes, of_conditions, inside = keep(B.drug_genes(spark, d), "genes"), keep(B.condition_genes(spark, d), "genes"), B.train_drugs(spark, d)
    cold = pairs.join(S.cold_conditions(pairs.select("condition")), "condition")
    splits = {"standard": (pairs.join(inside, "drug", "left_semi"), pairs.join(inside, "drug", "left_anti")), "cold": (cold.where("not cold").drop("cold"), cold.where("cold").drop("cold"))}
    tables = {}
    for name, (train, held_out) in splits.items():
        near = N.neighbour_counts(pairs, genes.withColumnRenamed("gene", "value"), train.select("drug").distinct(), train.where("y = 1"))
        known = keep(T.rates(train), "rates")
        for part, rows in (("train", train), ("held_out", held_out)):
            copied = N.transported_rate(rows.select("drug", "condition"), near, known).select("drug", "condition", *COPYING)
            free = N.overlap(rows.select("drug", "condition"), genes, of_conditions, "gene", "score").select("drug", "condition", *FREE)
            tables[name, part] = keep(rows.join(copied, ["drug", "condition"]).join(free, ["drug", "condition"]), "design")
    designs_ = {"copying": COPYING, "free": FREE, "union": COPYING + FREE}
    cases = [(split, design) for split in splits for design in designs_]
    fits = M.at_once(spark, [lambda s=s, f=f: M.fit(tables[s, "train"], designs_[f], "y", M.boosted, rounds=min(FEWER_ROUNDS, M.ROUNDS)) for s, f in cases])
    parts = []
    for (split, design), model in zip(cases, fits, strict=True):
        auc = R.macro_auc(model.score(tables[split, "held_out"]).select("drug", "y", "score"), min_pairs=5)
        parts.append(auc.select(F.lit(split).alias("split"), F.lit(design).alias("design"), r6(F.col("macro_auc")).alias("macro_auc"), "n_groups"))
    return reduce(DataFrame.unionByName, parts)


@query
def train_held_out_gap(spark: SparkSession, d: str) -> DataFrame:
    """Mean AUC of drugs out of fold in train and on held-out rows, and whether train exceeds them by too much."""
    train, held_out = designs(spark, d)
    own = M.out_of_fold(train, FEATURES, "y", "group_key", M.logistic)
    told = M.fit(train, FEATURES, "y", M.logistic).score(held_out)
    cv, validate = (R.macro_auc(rows.select("drug", "y", "score"), min_pairs=5).select(F.col("macro_auc").alias(name)) for rows, name in ((own, "train_auc"), (told, "held_out_auc")))
    both = cv.withColumn("held_out_auc", validate.scalar())
    return both.select(r6(F.col("train_auc")).alias("train_auc"), r6(F.col("held_out_auc")).alias("held_out_auc"), r6(F.col("train_auc") - F.col("held_out_auc")).alias("gap"), M.gap(F.col("train_auc"), F.col("held_out_auc")).alias("too_wide"))
