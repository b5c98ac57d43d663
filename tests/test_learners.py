import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import learners as M
from pairloom.operators import metrics as R

SCHEMA = "drug long, condition long, g string, x double, z double, nothing double, y int"


@pytest.fixture(scope="module")
def pairs(spark):
    """Label follows x; z is noise; groups g hold whole drugs."""
    rng = random.Random(3)
    rows = []
    for drug in range(40):
        for condition in range(25):
            x = rng.random()
            rows.append((drug, condition, f"g{drug // 4}", None if rng.random() < 0.03 else x, rng.random(), 0.0, int(x + rng.gauss(0, 0.2) > 0.6)))
    rows.append((99, 1, None, 0.5, 0.5, 0.0, 1))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("learner, options", [(M.logistic, {}), (M.boosted, {"rounds": 12})])
def test_scores_out_of_fold(pairs, learner, options):
    scored = M.out_of_fold(pairs, ["x", "z", "nothing"], "y", "g", learner, **options).cache()
    assert scored.count() == 1000  # the row without a group is in no fold
    assert scored.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n <> 1").isEmpty()
    assert scored.select("fold").distinct().count() == 3
    assert R.macro_auc(scored).first()[0] > 0.85
    folds = M.fold_precision(scored).collect()
    assert sum(r.n for r in folds) == 1000 and all(r.average_precision > 0.7 for r in folds)
    plain = {r.fold: r.average_precision for r in R.average_precision(scored, "fold").collect()}
    assert all(abs(plain[r.fold] - r.average_precision) < 1e-9 for r in folds)


def test_a_fold_is_scored_by_a_model_that_never_saw_it(spark):
    # each group has its own sign: a model that had seen the group would rank it well
    rng = random.Random(4)
    rows = [(g, g * 10.0 + (y if g % 2 else 1 - y) * 5, y) for g in range(9) for y in (0, 1) for _ in range(30) if rng]
    df = spark.createDataFrame(rows, "g long, x double, y int")
    seen = M.fit(df, ["x"], "y", M.boosted, rounds=20).score(df).select(F.lit(1).alias("drug"), "y", "score")
    unseen = M.out_of_fold(df, ["x"], "y", "g", M.boosted, rounds=20).select(F.lit(1).alias("drug"), "y", "score")
    assert R.macro_auc(seen).first()[0] > 0.95
    assert R.macro_auc(unseen).first()[0] < 0.7


def test_regressions(pairs):
    for learner, options in ((M.linear, {}), (M.boosted_regression, {"rounds": 12}), (M.forest, {"trees": 8})):
        scored = M.out_of_fold(pairs.where("x is not null"), ["x", "z"], "x", "g", learner, **options).select(F.col("x").alias("t"), "score")
        assert R.regression_errors(scored, "t", "score").first().pearson > 0.9


def test_importances_and_gaps_of_features(pairs, spark):
    model = M.fit(pairs, ["z", "x", "nothing"], "y", M.boosted, rounds=12)
    found = model.importances(2)
    assert [f for _, f, _ in found] == ["x", "z"] and found[0][2] > 0.5
    assert model.medians[2] == 0.0
    # train's medians fill the gaps of other rows; NaN is a gap as well
    other = spark.createDataFrame([(None, None), (float("nan"), float("nan")), (model.medians[0], model.medians[1])], "z double, x double").withColumn("nothing", F.lit(None).cast("double"))
    assert len({r.score for r in model.score(other).collect()}) == 1


def test_one_sided_and_empty_train(pairs, spark):
    assert {r.score for r in M.fit(pairs.where("y = 1"), ["x"], "y", M.boosted).score(pairs).select("score").distinct().collect()} == {1.0}
    empty = M.fit(pairs.limit(0), ["x"], "y", M.logistic)
    assert [r.score for r in empty.score(pairs.limit(1)).collect()] == [None]
    assert empty.importances() == [(1, "x", 0.0)]
    assert M.out_of_fold(pairs.limit(0), ["x"], "y", "g", M.logistic).count() == 0


def test_degree_features_are_of_train_alone(spark):
    train = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (2, 1, 0), (3, 1, 1)], "drug long, condition long, y int")
    rows = spark.createDataFrame([(1, 1, 0), (9, 2, 1), (9, 9, 1)], "drug long, condition long, y int")
    got = {(r.drug, r.condition): (round(r.log_drug_degree, 6), round(r.log_condition_degree, 6), round(r.p_c, 6)) for r in M.degree_features(train, rows).collect()}
    ln = lambda n: round(float(__import__("math").log1p(n)), 6)
    assert got == {(1, 1): (ln(2), ln(3), 0.666667), (9, 2): (ln(1), ln(1), 0.0), (9, 9): (ln(1), ln(2), 0.333333)}


def test_learned_floor(spark):
    # a condition's rate tells everything: the floor is near 1, learned or looked up
    rng = random.Random(5)
    rows = [(d, c, int(rng.random() < (0.95 if c < 8 else 0.05))) for d in range(60) for c in range(25)]
    df = spark.createDataFrame(rows, "drug long, condition long, y int")
    out = M.learned_floor(df.where("drug < 40"), df.where("drug >= 40"), rounds=10).orderBy("min_pairs").collect()
    assert [r.min_pairs for r in out] == [5, 20]
    for r in out:
        assert r.floor_pc > 0.9 and r.floor_degree_pc > 0.9 and abs(r.prevalence - 0.338) < 0.05 and r.n_drugs_scored == 20


def test_zeroed_features(pairs):
    train, held = pairs.where("drug < 25"), pairs.where("drug between 25 and 39").withColumn("half", (F.col("condition") % 2).cast("int"))
    out = {(r.feature): r for r in M.zeroed_margins(train, held, ["x", "z", "nothing"], ["x", "z", "nothing"], rounds=10, seeds=(0, 1), share=0.8).collect()}
    assert out["nothing"].margin == 0.0 and out["nothing"].n_groups == 15
    assert out["x"].margin > 0.3 and abs(out["z"].margin) < 0.1
    assert out["x"].auc == pytest.approx(out["nothing"].zeroed_auc)
    by = M.zeroed_margins(train, held, ["x", "nothing"], ["nothing", "x"], by="half", rounds=5, seeds=(0,), min_pairs=10).collect()
    assert {(r.feature, r.half) for r in by} == {(f, h) for f in ("x", "nothing") for h in (0, 1)}
    assert all(r.margin == 0.0 for r in by if r.feature == "nothing")


def test_refits_in_a_subset(pairs):
    train, held = pairs.where("drug < 25"), pairs.where("drug between 25 and 39")
    out = M.refit_gains(train, held, ["x", "z"], "nothing", seeds=(0, 1), rounds=6).orderBy("seed").collect()
    assert [r.seed for r in out] == [0, 1] and all(r.base_auc > 0.8 and abs(r.gain) < 0.02 for r in out)
    gains = M.refit_gains(train, held, ["z"], "x", seeds=(0,), rounds=6).collect()
    assert gains[0].gain > 0.2
    small = M.refit_gains(train.limit(10), held, ["x"], "z", seeds=(0, 1)).collect()
    assert [(r.n_train, r.gain) for r in small] == [(10, None)] * 2


def test_gap():
    M.check_gap(0.8, 0.7)
    with pytest.raises(ValueError, match="0.2000"):
        M.check_gap(0.9, 0.7)


@pytest.mark.parametrize("learner, label", [(M.logistic, "y"), (M.boosted, "y"), (M.linear, "z"), (M.boosted_regression, "z")])
def test_equal_rows_are_fitted_as_one(spark, monkeypatch, learner, label):
    rng = random.Random(8)
    rows = []
    for _ in range(1500):
        a, b = rng.randrange(5), rng.randrange(4)
        rows.append((float(a), float(b), int(rng.random() < 0.15 * a + 0.05 * b), float(a * b + rng.randrange(3))))
    df = spark.createDataFrame(rows, "a double, b double, y int, z double")
    options = {"rounds": 8} if "boosted" in learner.__name__ else {}
    plain = M.fit(df, ["a", "b"], label, learner, **options)
    sizes, whole = [], M.weighted
    monkeypatch.setattr(M, "GROUPED_FROM", 100)
    monkeypatch.setattr(M, "weighted", lambda model, n: sizes.append(n) or whole(model, n))
    alike = M.fit(df, ["a", "b"], label, learner, **options)
    every = alike.score(plain.score(df), "other").distinct().collect()
    assert sizes == [1500] and all(r.score == pytest.approx(r.other, abs=1e-4) for r in every)
    assert M.weighted(M.forest(), 100) is None and M.weighted(M.boosted(share=0.8), 100) is None


def test_partitions_are_no_more_than_cores(pairs, monkeypatch):
    seen = []
    real = M.logistic().__class__.fit
    monkeypatch.setattr(M.LogisticRegression, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or real(self, rows))
    monkeypatch.setattr(M, "ROWS_A_PART", 10)
    M.fit(pairs, ["x"], "y", M.logistic)
    assert seen == [pairs.sparkSession.sparkContext.defaultParallelism]
