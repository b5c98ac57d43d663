"""Small literal tables with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions import labels as L
from pairloom.functions import text as X
from pairloom.operators import joins as J
from pairloom.operators import mapping as M
from pairloom.operators import metrics as R
from pairloom.operators import network as N
from pairloom.operators import ontology as O
from pairloom.operators import splits as S
from pairloom.operators import statistics as T


def one(spark, expr_of, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr_of(F.col("v")).alias("x")).collect()]


CEM = [
    (1, 10, "t", 3, 2.0, 4.0, None),
    (1, 11, "t", 2, 9.0, 40.0, None),
    (1, 12, "f", None, None, None, "TREATS=2"),
    (2, 10, "f", None, None, None, "NEG_TREATS=1"),
    (2, 11, "f", None, None, None, "TREATS=1;NEG_TREATS=4"),
    (2, 12, "f", None, None, None, "CAUSES=1;TREATS=3"),
    (3, 10, "f", None, None, None, "AFFECTS=2;NEG_CAUSES=1"),
    (3, 11, "t", None, 5.0, 5.0, "BAD=x"),
]


def test_labels(spark):
    cem = spark.createDataFrame(CEM, "drug int, condition int, in_faers string, cases int, prr double, chi double, relations string")
    rows = L.sentence_sums(L.build_labels(cem)).select(
        "*", L.signal(F.col("in_faers") == "t", F.col("cases"), F.col("prr"), F.col("chi")).alias("signal"), L.signal_or_false(F.col("cases"), F.col("prr"), F.col("chi")).alias("flat")
    )
    got = {(r.drug, r.condition): r for r in rows.collect()}
    assert [got[k].signal for k in sorted(got)] == [True, False, None, None, None, None, None, None]
    assert [got[k].flat for k in sorted(got)] == [True] + [False] * 7
    assert (got[1, 12].efficacy_label, got[2, 10].efficacy_label, got[2, 10].n_treats) == (1, 0, 0)
    assert got[2, 11].efficacy_label is None and got[2, 11].efficacy_contradicted
    assert got[2, 12].treats_and_causes and got[3, 10].harm_label == 0 and got[3, 10].nondirectional_asserted == 2
    assert (got[3, 10].negated_sentences, got[2, 12].harm_sentences, got[2, 12].benefit_sentences) == (1, 1, 3)


def test_relation_map_keeps_the_last_of_equal_names(spark):
    assert one(spark, L.relation_map, "A=1; A =2;B=x;C", "", None) == [{"A": 2, "B": 0, "C": 0}, {}, {}]


def test_text(spark):
    assert one(spark, X.normalise, "Ménière disease (disorder)", "A&B  c-d", None) == ["meniere disease", "a and b c d", ""]
    assert one(spark, X.token_key, "pain of joint", "joint pain", "the of") == ["joint pain", "joint pain", ""]
    assert one(spark, X.colon_id, "HP_0000118", "UBERON_1", "a_b", "x") == ["HP:0000118", "UBERON:1", "a_b", "x"]
    assert one(spark, X.underscore_id, "A:B:C") == ["A_B:C"]
    assert one(spark, X.xref, "SCTID:1", "snomedct_us: 2 ", "ORPHA:3", "FOO:4", "MESH:", "none") == [("SNOMED", "1"), ("SNOMED", "2"), ("Orphanet", "3"), None, None, None]
    assert one(spark, X.truth, "1", " True", "T", "0", "f", None) == [True, True, True, False, False, False]
    assert one(spark, X.whole, "123.0", "7", "x", None) == [123, 7, None, None]
    assert one(spark, X.drug_name, "Vitamin (+)-D3", "()") == ["vitamind3", None]


EDGES = [("A", "R"), ("B", "R"), ("C", "A"), ("C", "B"), ("D", "C"), ("D", "unknown")]


def test_ontology(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    terms = spark.createDataFrame([(t,) for t in "RABCDX"], "term string")
    closed = O.closure(edges, terms)
    assert {(r.term, r.ancestor, r.distance) for r in closed.collect()} == {("A", "R", 1), ("B", "R", 1), ("C", "A", 1), ("C", "B", 1), ("C", "R", 2), ("D", "C", 1), ("D", "A", 2), ("D", "B", 2), ("D", "R", 3)}
    assert {r.term: r.depth for r in O.depth(closed, terms, "R").collect()} == {"R": 0, "A": 1, "B": 1, "C": 2, "D": 3, "X": None}
    genes = spark.createDataFrame([("R", 1), ("R", 2), ("C", 1), ("C", 2), ("D", 2)], "term string, gene int")
    assert {(r.term, r.gene) for r in O.specific(genes, edges).collect()} >= {("C", 1), ("D", 2)}
    ic = {r.term: r.information_content for r in O.information_content(genes, "R").collect()}
    assert ic["R"] == 0 and ic["D"] == pytest.approx(0.693147, abs=1e-6)
    assert O.information_content(genes, "none").collect() == []
    loop = spark.createDataFrame([("A", "B"), ("B", "A")], "child string, parent string")
    assert {(r.term, r.ancestor) for r in O.closure(loop).collect()} == {("A", "B"), ("B", "A")}
    general = spark.createDataFrame([(1, 200), (2, 201), (3, None)], "t int, n_descendants int")
    assert {r.t for r in O.not_too_general(general).collect()} == {1, 3}


def test_mapping_takes_the_best_tier(spark):
    conditions = spark.createDataFrame([(1, "Joint pain", "9"), (2, "Ménière disease (disorder)", "0"), (3, "nothing", "0"), (4, "Arthralgia", "0")], "condition int, name string, code string")
    synonyms = spark.createDataFrame([(4, "arthralgia"), (4, "Pain of joint")], "condition int, synonym string")
    codes = spark.createDataFrame([("9", "T1")], "code string, term string")
    labels = spark.createDataFrame([("pain of joint", "T1"), ("Joint pain", "T2"), ("meniere disease", "T3")], "label string, term string")
    got = {(r.condition, r.term, r.tier) for r in M.tiered_mapping(conditions, synonyms, codes, labels).collect()}
    assert got == {(1, "T1", M.CODE), (1, "T2", M.LABEL), (2, "T3", M.LABEL), (3, None, M.NONE), (4, "T1", M.SYNONYM)}


def test_auc_properties(spark):
    rows = [(1, i, i % 3 == 0, float(i % 4)) for i in range(24)] + [(2, i, True, 1.0) for i in range(24)] + [(3, i, i == 0, 1.0) for i in range(5)] + [(4, i, i < 3, float("nan") if i == 5 else float(-i)) for i in range(20)] + [(5, i, i < 9, None) for i in range(20)]
    df = spark.createDataFrame([(d, c, int(y), s) for d, c, y, s in rows], "drug int, condition int, y int, score double")
    up = {r.drug: r.auc for r in R.group_auc(df).collect()}
    down = {r.drug: r.auc for r in R.group_auc(df.withColumn("score", -F.col("score"))).collect()}
    assert set(up) == {1, 4} and up[4] == 1.0
    assert all(up[k] + down[k] == pytest.approx(1) for k in up)
    p = {r.drug: r.precision for r in R.at_k(df).collect()}
    assert p[2] == 1.0 and p[3] == 0.2


def test_folds(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 6), ("c", 6), ("d", 3), ("e", 1)], "group_key string, n_pairs long")
    got = {r.group_key: r.fold for r in S.greedy_folds(sizes).collect()}
    # 10 to train; a six each to validate and test; then train lacks most
    assert got["a"] == "train" and {got["b"], got["c"]} == {"validate", "test"} and set(got) == set("abcde")
    bad = spark.createDataFrame([(1, "train"), (1, "test"), (2, "test")], "drug int, fold string")
    assert [r.drug for r in S.leaks(bad, "drug").collect()] == [1]


def test_placebos(spark):
    edges = spark.createDataFrame([(i, (i * 7 + k) % 23) for i in range(40) for k in range(3)], "a int, b int").distinct()
    new = T.swap_edges(edges, "a", "b", rounds=3)
    for key in ("a", "b"):
        assert sorted(map(tuple, new.groupBy(key).count().collect())) == sorted(map(tuple, edges.groupBy(key).count().collect()))
    assert new.distinct().count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").count() > 20
    rows = spark.createDataFrame([("g", i, i * i) for i in range(20)], "g string, k int, v int")
    assert sorted(r.placebo for r in T.permuted(rows, "g", "k", "v").collect()) == [i * i for i in range(20)]


def test_two_way_residuals_sum_to_nothing(spark):
    rows = spark.createDataFrame([(i % 5, i % 7, float(i * i % 11)) for i in range(35)], "a int, b int, v double")
    out = T.two_way_demean(rows, "a", "b", "v", rounds=20, tolerance=1e-9)
    assert all(abs(r[1]) < 1e-6 for r in out.groupBy("a").sum("residual").collect())


def test_neighbours_and_rungs(spark):
    edges = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h"), (4, None)], "drug int, value string")
    train = spark.createDataFrame([(1,), (3,)], "drug int")
    assert {tuple(r) for r in N.neighbours(edges, train).collect()} == {(2, 1)}
    drugs = spark.createDataFrame([(i,) for i in range(1, 6)], "drug int")
    got = {r.drug: r.rung for r in N.rungs(drugs, train, {"gene": edges}, spark.createDataFrame([(4,)], "drug int")).collect()}
    assert got == {1: "D0", 2: "D0", 3: "D0", 4: "D1", 5: "D2"}
    joined = N.connected(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string"), "a", "b")
    assert {r.node: r.component for r in joined.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_joins(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    table = spark.createDataFrame([("a", 5), ("a", 5)], "v string, w int")
    assert J.lookup(left, table, "v").count() == 2
    routes = spark.createDataFrame([(1, 1, 4, 2, "ontology", 7), (1, 1, 3, 9, "mesh", None)], "drug int, condition int, max_phase int, n_refs int, route string, n_descendants int")
    assert tuple(J.pair_indications(routes).first()) == (1, 1, 4, 9, "mesh+ontology", 7, True)
    assert T.forbidden(["a", "faers_x", "y"], ("y",), ("faers_",)) == ["faers_x", "y"]


def test_nested_records(spark):
    rows = spark.createDataFrame([("a", [("b", [("c", None), ("d", None)]), ("e", [])])], "id string, children array<struct<id:string,children:array<struct<id:string,children:string>>>>")
    assert {(r.id, r.depth) for r in O.tree_rows(rows, "id", "children", 5).collect()} == {("a", 0), ("b", 1), ("e", 1), ("c", 2), ("d", 2)}
    genes = spark.createDataFrame([("g", [("P1", "x"), (None, "y")]), ("h", [])], "gene string, pathways array<struct<pathwayId:string,pathway:string>>")
    assert {tuple(r) for r in N.pathways(genes).collect()} == {("g", "P1"), ("g", "y")}
    terms = spark.createDataFrame([("HP_1", ["SCTID:1", "sctid:1", "FOO:2"])], "id string, refs array<string>")
    assert [tuple(r) for r in O.term_xrefs(terms, "id", "refs").collect()] == [("HP:1", "SNOMED", "1")]
    first = spark.createDataFrame([("A", "a")], "id string, name string")
    sssom = spark.createDataFrame([("A", "x", "skos:exactMatch", "M:1"), ("B", "b", "skos:broadMatch", "M:2")], "subject_id string, subject_label string, predicate_id string, object_id string")
    assert {tuple(r) for r in O.merged_terms(first, sssom).collect()} == {("A", "a"), ("B", "b")}
    assert [tuple(r) for r in O.exact_xrefs(sssom).collect()] == [("A", "M:1")]


def test_evidence_by_symbol(spark):
    evidence = spark.createDataFrame([(1, "E1", 0.5), (1, "E2", 0.7), (1, "E3", 0.9)], "condition int, gene string, max_score double")
    symbols = spark.createDataFrame([("E1", "S"), ("E2", "S")], "gene string, symbol string")
    assert [tuple(r) for r in M.to_symbols(evidence, symbols).collect()] == [(1, "S", 0.7, 2)]
    panel = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, affinity double")
    guess = spark.createDataFrame([(2, 1.0), (3, 2.0)], "k int, affinity double")
    assert {tuple(r) for r in N.measured_or_imputed(panel, guess, ["k"]).collect()} == {(1, 5.0, True), (2, 6.0, True), (3, 2.0, False)}


def test_imputation_by_group(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "g string, v double")
    assert sorted((r.g, r.v) for r in J.impute(rows, "v", "g").collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0)]
    assert [r.v for r in J.impute(rows.where("g = 'b'"), "v").collect()] == [0.0]


def test_trees_of_any_depth(spark):
    import json

    from pairloom.operators import ontology as O

    def chain(n, at=1):
        node = {"id": f"n{at}", "name": None if at % 9 == 0 else f"x{at}", "children": []}
        if at < n:
            node["children"] = [chain(n, at + 1), {"id": f"side{at}", "name": "s"}, {"id": f"none{at}", "children": []}]
        return node

    top = {"id": "t", "level": 5, "children": [{"id": "a", "level": 7, "children": [{"id": "leaf"}]}, {"id": "b", "children": [{"id": "c", "children": [{"id": "d"}]}]}, {"id": "seed"}]}
    rows = [(1, json.dumps(chain(70))), (2, json.dumps(top)), (3, '{"id": "alone"}'), (4, "no json"), (5, None)]
    got = O.json_tree(spark.createDataFrame(rows, "seed int, body string"), "seed", "body", "id string, name string").collect()
    # a node without children is listed only at the top: it is no ancestor of what was asked for
    assert sorted((r.id, r.level) for r in got if r.seed == 1) == sorted((f"n{k}", k) for k in range(1, 70))
    assert sorted((r.id, r.level) for r in got if r.seed == 2) == [("a", 7), ("b", 2), ("c", 3), ("t", 5)]
    assert [(r.seed, r.id, r.level) for r in got if r.seed > 2] == [(3, "alone", 1)]
    assert {r.name for r in got if r.id == "n9"} == {None}
    assert O.json_tree(spark.createDataFrame([], "seed int, body string"), "seed", "body", "id string").count() == 0


def test_slopes_and_agreement(spark):
    from pairloom.operators import metrics as R
    from pairloom.operators import statistics as T

    rows = spark.createDataFrame([(k, k / 10.0, 3 * k / 10.0 + (k % 7 - 3) / 10.0) for k in range(80)] + [(99, None, 1.0), (98, 1.0, None)], "k int, x double, y double")
    r = T.slope_interval(rows, "k", "x", "y").first()
    assert r.n == 80 and abs(r.slope - 3) < 0.05 and 2.8 < r.low < r.slope < r.high < 3.2
    assert tuple(T.slope_interval(rows.withColumn("x", F.lit(1.0)), "k", "x", "y").first())[1:] == (None, None, None)
    assert tuple(T.slope_interval(rows.limit(0), "k", "x", "y").first())[1:] == (None, None, None)
    weights = spark.range(20000).select(T.weight(1, F.col("id").cast("string")).alias("w")).groupBy("w").count().collect()
    share = {w.w: w["count"] / 20000 for w in weights}
    assert abs(share[0] - 0.3679) < 0.02 and abs(share[1] - 0.3679) < 0.02 and abs(share[2] - 0.1839) < 0.02 and abs(sum(w * s for w, s in share.items()) - 1) < 0.03
    ranking = spark.createDataFrame([("p", "a", 0.9), ("p", "b", 0.5), ("q", "a", 0.7), ("q", "b", 0.7), ("r", "a", None)], "label string, feature string, value double")
    assert sorted(map(tuple, R.best_features(ranking).collect())) == [("p", "a", True), ("q", "a", True)]
    more = ranking.union(spark.createDataFrame([("s", "b", 0.1)], ranking.schema))
    assert {x.agree for x in R.best_features(more).collect()} == {False}


def test_tanimoto_by_brute_force(spark):
    import random

    from pairloom.operators import network as N

    rng = random.Random(9)
    sets = {i: sorted(rng.sample(range(200), rng.choice([0, 1, 5, 40, 120]))) for i in range(150)}
    sets[150] = sets[3]
    rows = spark.createDataFrame([*sets.items(), (3, [1, 2]), (None, [1]), (151, None)], "id long, bits array<int>").repartition(5)
    every = [(i, set(b)) for i, b in sets.items()] + [(3, {1, 2})]
    expected = {}
    for i, b in every:
        alike = [len(b & c) / len(b | c) for j, c in every if j != i and b | c]
        expected[i] = max([expected.get(i, 0.0), *alike])
    for size in (16_384, 40):
        got = N.tanimoto(rows.where("id % 3 = 0"), rows, queries_a_pass=size).collect()
        assert len(got) == 52 and all(abs(r.best - expected[r.id]) < 1e-12 for r in got)
    words = N.tanimoto(spark.createDataFrame([("a", [70000, 3])], "id string, bits array<int>"), spark.createDataFrame([("a", [3]), ("b", [3, 5])], "id string, bits array<int>")).collect()
    assert [(r.id, round(r.best, 6)) for r in words] == [("a", 0.333333)]
    assert N.tanimoto(rows.limit(0), rows).count() == 0 and {r.best for r in N.tanimoto(rows.where("id < 5"), rows.limit(0)).collect()} == {0.0}


def test_ranks_of_one_large_group(spark):
    import random

    rng = random.Random(11)
    rows = [(g, None if rng.random() < 0.1 else rng.randint(0, 40) / 7, rng.randint(0, 1)) for g in ("a", "b") for _ in range(900 if g == "a" else 30)] + [("c", 1.0, 1), (None, 1.0, 0)]
    df = spark.createDataFrame(rows, "drug string, score double, y int")
    plain, spread = ({r.drug: (r.n, r.positives, round(r.auc, 9)) for r in R.group_auc(df, spread=s).collect()} for s in (False, True))
    assert plain == spread and set(plain) == {"a", "b"}
    median = sorted(s for g, s, _ in rows if g == "b" and s is not None)
    median = (median[(len(median) - 1) // 2] + median[len(median) // 2]) / 2
    b = [(median if s is None else s, y) for g, s, y in rows if g == "b"]
    wins = [(x > z) + (x == z) / 2 for x, p in b for z, q in b if p and not q]
    assert abs(plain["b"][2] - sum(wins) / len(wins)) < 1e-9


def test_intervals_of_means(spark):
    import random
    import statistics

    from pairloom.operators import statistics as T

    rng = random.Random(12)
    values = [rng.gauss(5, 2) for _ in range(400)]
    df = spark.createDataFrame([(k, "o", v) for k, v in enumerate(values)] + [(k, "p", 1.0) for k in range(9)] + [(1, "q", None)], "k int, o string, v double")
    r = T.bootstrap(df.where("o = 'o'"), "k", "v", rounds=500).first()
    mean, error = statistics.mean(values), statistics.stdev(values) / 20
    assert abs(r.mean - mean) < 1e-9 and abs(r.low - (mean - 1.96 * error)) < 0.06 and abs(r.high - (mean + 1.96 * error)) < 0.06
    got = {r.o: r for r in T.bootstrap_by(df, "o", "k", "v").collect()}
    assert set(got) == {"o", "p"} and (got["p"].n, got["p"].low, got["p"].high) == (9, 1.0, 1.0) and got["o"].low < mean < got["o"].high
    assert tuple(T.bootstrap(df.limit(0), "k", "v").first()) == (None, None, None)


def test_outcomes_are_resampled_with_replacement(spark, monkeypatch):
    """Each round draws as many groups as there are; small slices and tasks give the same."""
    import hashlib
    import statistics

    from pairloom.operators import statistics as T

    own = {"a": [float(k * k % 7) for k in range(50)], "b": [1.0, 2.0, 9.0]}
    df = spark.createDataFrame([(k, o, v) for o, vs in own.items() for k, v in enumerate(vs)], "k int, o string, v double")
    want = {}
    for o, vs in own.items():
        n = len(vs)
        draws = [[vs[int(hashlib.md5(f"{o}|{b}|{i}|42".encode()).hexdigest()[:8], 16) % n] for i in range(n)] for b in range(30)]
        means = sorted(sum(x) / n for x in draws)
        want[o] = (n, statistics.mean(vs), means[0], means[-1])
    for part, turns, step in ((4_000_000, 20, 100_000), (8, 7, 5)):
        for name, size in (("GROUPS_A_SLICE", part), ("ROUNDS_A_TASK", turns), ("PLACES_A_STEP", step)):
            monkeypatch.setattr(T, name, size)
        got = T.bootstrap_by(df, "o", "k", "v", rounds=30, quantiles=(0.0, 1.0)).collect()
        assert {r.o: tuple(round(x, 9) for x in (r.n, r.mean, r.low, r.high)) for r in got} == {o: tuple(round(x, 9) for x in w) for o, w in want.items()}


def test_classes_of_one_size_are_dealt_as_one_by_one(spark):
    import hashlib
    import random

    from pairloom.operators import splits as S

    rng = random.Random(13)
    for m, folds in ((1, S.FOLDS), (7, S.FOLDS), (600, S.FOLDS), (300, {"a": 0.25, "b": 0.25, "c": 0.5}), (40, {"only": 1.0})):
        sizes = {f"g{k}": rng.choice([1, 1, 1, 2, 3, 7, rng.randint(1, 60)]) for k in range(m)}
        total, dealt, expected = sum(sizes.values()), dict.fromkeys(folds, 0), {}
        for key in sorted(sizes, key=lambda k: (-sizes[k], hashlib.md5(f"{k}42".encode()).hexdigest())):
            lack = {f: (s * total - dealt[f]) / (s * total) for f, s in folds.items()}
            expected[key] = max(folds, key=lambda f: lack[f])
            dealt[expected[key]] += sizes[key]
        got = S.greedy_folds(spark.createDataFrame(list(sizes.items()), "group_key string, n_pairs long"), folds=folds)
        assert {r.group_key: r.fold for r in got.collect()} == expected
    assert S.greedy_folds(spark.createDataFrame([], "group_key string, n_pairs long")).count() == 0
    # many small groups: as many steps as sizes
    import numpy as np

    starts = S.class_starts([(1, 10_000_000), (2, 3_000_000), (50, 9)], np.array([0.5, 0.3, 0.2]) * 16_000_450)
    assert [s[:2] for s in starts] == [(50, 0), (2, 9), (1, 3_000_009)]
    assert abs(starts[2][2][0] / sum(starts[2][2]) - 0.5) < 1e-5
