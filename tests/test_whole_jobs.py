"""Queries on small tables of their own, against brute force, where the given tables hide a cut."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import metrics as R
from pairloom.operators import network as N
from pairloom.operators import ontology as O
from pairloom.plans import analysis as A
from pairloom.plans import base as B


@pytest.fixture(scope="module")
def hub_dir(spark, tmp_path_factory):
    """60 drugs and 4 parts; each drug has gene g0 and one of g1, g2, so that g0 is a gene of 60 drugs."""
    where = str(tmp_path_factory.mktemp("hub"))
    spark.range(60).select(F.col("id").alias("s_suppkey")).write.parquet(f"{where}/supplier.parquet")
    parts = [(0, "b0", "g0"), (1, "b1", "g1"), (2, "b1", "g2"), (3, "b0", "g3")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(f"{where}/part.parquet")
    lines = [(s, p, s, q, f, "O") for s in range(60) for p in (0, 1 + s % 2, 3) for q, f in [(50.0, "R" if p < 3 else "A")] + [(9.0, "R" if (s * 7 + p) % 5 < 2 else "A")] * (4 + s * s % 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{where}/lineitem.parquet")
    return where


def test_neighbours_of_hub_genes(spark, hub_dir):
    genes = {}
    for r in B.drug_genes(spark, hub_dir).collect():
        genes.setdefault(r.drug, set()).add(r.gene)
    train = {d for d in range(60) if d % 3}
    near = {d: {o for o in train if o != d and genes.get(d, set()) & genes.get(o, set())} for d in range(60)}
    flagged = {(r.drug, r.condition) for r in B.scored(spark, hub_dir).where("y = 1").collect()}
    got = A.neighbour_shrunk_rate(spark, hub_dir).collect()
    assert len(got) == 120 and any(r.n_flagged for r in got)
    for r in got:
        assert r.n_neighbours == len(near[r.drug]) >= 39
        assert r.n_flagged == sum((o, r.condition) in flagged for o in near[r.drug])
    assert tuple(A.neighbour_coverage(spark, hub_dir).first()) == (1.0, 1.0, 0.0)


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "DRUGS_A_BLOCK", 4)
    rows = [(d, v) for d in range(30) for v in ("hub", f"pair{d // 2}", None) if v != "hub" or d % 5]
    train = spark.createDataFrame([(d,) for d in range(0, 30, 2)], "drug int")
    got = sorted(map(tuple, N.neighbours(spark.createDataFrame(rows, "drug int, value string"), train).collect()))
    assert got == sorted((a, b) for a in range(30) for b in range(0, 30, 2) if a != b and (a // 2 == b // 2 or (a % 5 and b % 5)))


def test_neighbours_are_counted_without_pairs(spark, monkeypatch):
    rng = random.Random(6)
    values = {d: {f"v{rng.randrange(9)}" for _ in range(3)} | ({"hub"} if d % 5 else set()) for d in range(150)}
    train = {d for d in range(150) if d % 3}
    flagged = {(d, c) for d in train for c in range(6) if rng.random() < (0.02 if c == 5 else 0.4)}
    edges = spark.createDataFrame([(d, v) for d, vs in values.items() for v in vs] + [(1, None), (900, "alone")], "drug int, value string")
    pairs = spark.createDataFrame([(d, c) for d in range(150) for c in range(6)] + [(900, 1)], "drug int, condition int")
    near = {d: {o for o in train if o != d and values[d] & values[o]} for d in range(150)}
    want = {(d, None): len(near[d]) for d in near} | {(d, c): sum((o, c) in flagged for o in near[d]) for d in near for c in range(6)}
    monkeypatch.setattr(N, "neighbours", None)  # no pair is formed
    for chunk, block, dense in ((4096, 65_536, 512), (20, 64, 5)):
        for name, size in (("DRUGS_A_CHUNK", chunk), ("BITS_A_BLOCK", block), ("DENSE", dense)):
            monkeypatch.setattr(N, name, size)
        got = N.neighbour_counts(pairs, edges, spark.createDataFrame([(d,) for d in train], "drug int"), spark.createDataFrame(sorted(flagged), "drug int, condition int"))
        assert {(r.drug, r.condition): r.n for r in got.collect()} == {k: n for k, n in want.items() if n}


def tau_b(pairs):
    sign = lambda v: (v > 0) - (v < 0)
    both = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(pairs) for b in pairs[:i]]
    return sum(s * t for s, t in both) / (sum(s * s for s, _ in both) * sum(t * t for _, t in both)) ** 0.5


def test_tau_of_all_drugs(spark, hub_dir):
    ranks = B.scored(spark, hub_dir).groupBy("drug").agg(F.sum("score"), F.sum("case_count")).collect()
    want = tau_b([r[1:] for r in ranks])
    assert len(ranks) == 60 and abs(want - tau_b([r[1:] for r in ranks if r[0] < 40])) > 1e-3
    assert A.kendall_tau(spark, hub_dir).first()[0] == pytest.approx(want, abs=1e-6)
    varied = [(i, float(i * 37 % 101 // 3), i * 53 % 89 // 2) for i in range(150)]
    plan = R.kendall_tau_b(spark.createDataFrame(varied, "i int, x double, y int"), "i", "x", "y")
    assert plan.first()[0] == pytest.approx(tau_b([v[1:] for v in varied]), abs=1e-12)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "_one" not in plan._jdf.queryExecution().toString()
    flat = spark.createDataFrame([(i, 1.0, i) for i in range(3)], "i int, x double, y int")
    assert R.kendall_tau_b(flat, "i", "x", "y").first()[0] is None


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(66)], "child int, parent int").coalesce(1)
    assert sorted(map(tuple, O.closure(chain).collect())) == [(a, b, b - a) for a in range(66) for b in range(a + 1, 67)]


def test_pathways_beyond_the_tenth_gene(spark, tmp_path):
    """12 genes of one condition, each with a pathway of its own; drug 0 has them all, drug 1 the last alone."""
    parts = [(i, "b", f"g{i:02}", f"p{i:02}", 50) for i in range(12)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(0, i, s, 50.0, "R", "O") for s in (0, 1) for i in range(12) if s == 0 or i == 11]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.drug: (r.n_shared, r.jaccard) for r in A.pathway_overlap(spark, str(tmp_path)).collect()}
    assert got == {0: (12, 1.0), 1: (1, round(1 / 12, 6))}
