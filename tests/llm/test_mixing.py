import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import mixing as M


def filled(sizes):
    """Targets by resharing the excess until none is above (sizes in source order)."""
    weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, out, live = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while live:
        share = (total - sum(out[i] for i in range(len(sizes)) if i not in live)) / sum(weights[i] for i in live)
        over = {i for i in live if share * weights[i] >= 2 * sizes[i]}
        for i in live:
            out[i] = min(share * weights[i], 2.0 * sizes[i])
        if not over:
            break
        live -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 5, 5, 700], [0, 0], [7], [1, 1000, 1], [50, 3, 900, 0, 20, 20]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, size long, copies long")
    got = {r.source: r.target for r in M.targets(rows).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(filled(sizes))


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = M.Mix(docs, shards=8)
    rows = mix.taken().collect()
    assert len(rows) == docs.count()
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size for r in rows)
    per = {}
    for r in rows:
        per.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), mine in per.items():
        assert sum(r.size for r in mine) == size
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine) / 2 + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.Mix(docs, shards=8).taken().collect()))
    drawn = mix.drawn()
    assert drawn.groupBy("src", "at", "size", "pass").count().where("count > 1").isEmpty()
    taken = {r.doc_id: r.taken for r in rows}
    mixed = mix.documents()
    assert mixed.columns == docs.columns
    for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.first(M.words(F.col("text"))).alias("size")).collect():
        assert r.n * r.size == taken.pop(r.doc_id)
    assert not any(taken.values())


def test_tree_is_hypergeometric(spark):
    quota = spark.createDataFrame([(1, 40), (2, 60), (3, 0)], "src int, draws long")
    first = []
    for seed in range(40):
        rows = M.splitting_tree(quota, 4, seed).collect()
        got = {(r.src, r.shard): r.draws for r in rows}
        assert all(r.first == sum(got[r.src, k] for k in range(r.shard)) for r in rows)
        assert [sum(got[s, k] for k in range(4)) for s in (1, 2, 3)] == [40, 60, 0]
        assert [sum(got[s, k] for s in (1, 2, 3)) for k in range(4)] == [25] * 4
        first += [got[1, k] for k in range(4)]
    assert abs(np.mean(first) - 10) < 1e-9 and 1.7 < np.std(first) < 2.6  # sqrt(25 * .4 * .6 * 75 / 99) = 2.13


def test_draws_from_the_distribution(spark):
    from math import comb

    rows = spark.range(20000).select(M.hypergeometric(F.lit(6), F.lit(9), F.lit(5), M.uniform(F.col("id").cast("string"))).alias("k")).groupBy("k").count().collect()
    for r in rows:
        assert r["count"] / 20000 == pytest.approx(comb(6, r.k) * comb(9, 5 - r.k) / comb(15, 5), abs=0.012)


def replayed(quota, shards, seed):
    """The tree's deal from its definition: exact probabilities, added up outwards from the mode until they exceed the number drawn."""
    from math import comb

    def uniform(*parts):
        return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16) + 0.5) / 2**60

    nodes = {(1, 0): list(quota)}
    for level in (2**k for k in range(shards.bit_length() - 1)):
        for node in range(level):
            have = nodes[level, node]
            left = sum(have)
            room, took = (left + node % 2) // 2, []
            for good in have:
                bad, u = left - good, uniform(f"{seed}:{level}", node, len(took))
                if good == 0 or room == 0:
                    k = 0
                elif bad == 0:
                    k = room
                else:
                    low, high = max(0, room - bad), min(good, room)
                    m = min(high, max(low, (good + 1) * (room + 1) // (good + bad + 2)))
                    order = [m] + [x for i in range(1, good + room + 2) for x in (m + i, m - i) if low <= x <= high]
                    total, k = 0.0, m
                    for x in order:
                        total += comb(good, x) * comb(bad, room - x) / comb(good + bad, room)
                        if u < total:
                            k = x
                            break
                took.append(k)
                left, room = left - good, room - k
            nodes[level * 2, node * 2] = took
            nodes[level * 2, node * 2 + 1] = [h - k for h, k in zip(have, took, strict=True)]
    return [nodes[shards, s] for s in range(shards)]


def test_shards_of_documents_follow_the_tree(spark, monkeypatch):
    """The shards reported for each document are those to which the tree, replayed, deals its blocks."""
    monkeypatch.setattr(M, "LEVELS_A_TABLE", 2)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}", "x") for i in range(120)], "doc_id long, text string, source string, shards string")
    mix = M.Mix(docs, shards=8, block_words=20)
    quota = [(r.src, r.blocks, r.passes, r.last_block, r.draws) for r in mix.quota.orderBy("src").collect()]
    deal = replayed([q[4] for q in quota], 8, 1)
    shard_of = {}
    for at, (src, blocks, passes, last, draws) in enumerate(quota):
        places = [s for s in range(8) for _ in range(deal[s][at])]
        for place, shard in enumerate(places):
            draw = place * M.STRIDE % draws
            shard_of[src, draw % blocks, draw // blocks] = shard
    blocks = {r.doc_id: (r.src, r.block) for r in mix.blocks.collect()}
    rows = mix.taken().collect()
    assert any("," in r.shards for r in rows) and len({s for r in rows for s in r.shards.split(",")}) > 6
    for r in rows:
        src, block = blocks[r.doc_id]
        draws = [shard_of[src, block, k] for k in range(2) if (src, block, k) in shard_of]
        assert [int(s) for s in r.shards.split(",") if s] == draws[: r.taken // r.size]


def test_copies_are_taken_one_by_one(spark):
    docs = spark.range(1000).selectExpr("if(id < 400, 7L, id) doc_id", f"repeat('w ', 50) text", "concat('s', id % 2) source")
    mix = M.Mix(docs, block_words=50_000)
    per = {}
    for r in mix.taken().collect():
        per.setdefault(r.target, []).append(r.taken)
    for target, taken in per.items():
        assert abs(sum(taken) - target) <= 25 and set(taken) <= {0, 50, 100}
    counts = {(r.doc_id, r.source): r["count"] for r in mix.documents().groupBy("doc_id", "source").count().collect()}
    assert sum(counts.values()) * 50 == sum(map(sum, per.values()))


def test_clashes_long_texts_and_shards(spark):
    names = ["_at", "_size", "_source", "_drawn", "_place", "_words", "_copy", "_DRAW", "a.b"]
    docs = spark.createDataFrame([(i, "long " * 60_000 if i == 3 else f"t {i}", None if i % 4 else "s", *[f"{c}{i}" for c in names]) for i in range(30)], ["doc_id", "text", "source", *names])
    mix = M.Mix(docs)
    assert mix.shards == M.FEWEST_SHARDS
    taken = {r.doc_id: r.taken // r.size for r in mix.taken().collect()}
    mixed = mix.documents()
    rows = mixed.collect()
    assert mixed.columns == docs.columns and mixed.rdd.getNumPartitions() == mix.shards
    before = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == before[r.doc_id] for r in rows)
    assert {d: sum(r.doc_id == d for r in rows) for d in taken} == taken


def test_edges(spark):
    schema = "doc_id long, text string, source string, taken int"
    assert M.Mix(spark.createDataFrame([], schema)).taken().collect() == []
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "a", 1), (None, "x y z", None, 1), (None, "x y z w", None, 1), (5, "p q", "a", 1), (5, "p q", "a", 1), (6, "r " * 900, "b", 1)], schema)
    mix = M.Mix(docs, shards=2)
    rows = mix.taken().collect()
    assert len(rows) == 7 and sum(r.size for r in rows) == 911
    assert {r.source_size for r in rows} == {7, 4, 900}
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mix.documents().columns == docs.columns
