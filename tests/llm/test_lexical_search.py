import math
import random
import re
from collections import Counter

import duckdb
import pytest

from pairloom.llm import lexical_search as L
from pairloom.llm import registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_force(docs, items, k=10):
    counts = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    counts = [c for c in counts if c[2]]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in counts:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, doc is not None, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def found(spark, docs, items, **how):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in L.search(d, i, **how).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_terms():
    for text in ["Über-Größe's 12\tÄ x_y", "A.B c’d　e", "", "...", "ÉCOLE École 1a2B", "a\x00b\x7fc"]:
        assert [w.decode() for w in L.terms_of(text.encode())] == words(text)
    assert L.terms_of(None) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]

    def text(most):
        return " ".join(rng.choice(vocabulary[: rng.choice([3, 10, 60])]) for _ in range(rng.randint(0, most)))

    docs = [(i, text(80)) for i in range(700)] + [(700 + i, "w1 w2 w55") for i in range(40)] + [(None, None), (None, "w59"), (5, "w58 w58")]
    items = [(i, text(30)) for i in range(25)] + [(90, "w55 w55"), (91, "nowhere"), (92, None), (93, "W59, w58")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert sorted(found(spark, docs, items), key=key) == sorted(brute_force(docs, items), key=key)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 500}" for _ in range(60))) for i in range(300)]
    items = [(i, " ".join(f"t{rng.randint(0, 499)}" for _ in range(20))) for i in range(9)]
    monkeypatch.setattr(L, "SLICE", 7)
    assert sorted(found(spark, docs, items, k=3, most_items=4, most_terms=50)) == sorted(brute_force(docs, items, 3))


def test_bounds_hold_every_score(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 200)))) for i in range(200)], "doc_id long, text string")
    index = L.build(docs, [b"a", b"b", b"c"])
    rows = index.table.collect()
    assert len(rows) == 200
    import numpy as np

    for r in rows:
        w = index.weights[np.array(r.terms, dtype=int)]
        exact = L.exact_impacts(w, np.array(r.occurrences), np.array([r.m]))
        level = np.frombuffer(bytes(r.impacts), dtype=np.uint8).astype(int)
        assert (level * L.steps(w) >= exact).all() and ((level - 1) * L.steps(w) < exact).all()


def test_odd_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (2, "")], [(1, "a"), (None, "b")]) == []
    docs = [(9, "b"), (None, "a a"), (3, "a a"), (3, "a a"), (8, "c"), (10, "long " * 100_000)]
    items = [(None, "a"), (1, "A a"), (1, "A a")]
    assert sorted(found(spark, docs, items), key=key) == sorted(brute_force(docs, items[:2]), key=key)
    d = spark.createDataFrame([(1, "a b", 5), (2, "c", 6), (3, "d", 7)], "doc_id long, text string, item_id int").selectExpr("*", "1 as m", "2 as terms")
    i = spark.createDataFrame([("x", "a")], "item_id string, text string").selectExpr("*", "1 as doc_id", "2 as item")
    assert [(r.item_id, r.rank, r.doc_id) for r in L.search(d, i).collect()] == [("x", 1, 1)]


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    expected = con.execute(registry.ORACLES["op12_lexical_search"]).df()[["item_id", "rank", "doc_id", "score"]]
    got = registry.op12_lexical_search(spark, sf_dir).toPandas()[["item_id", "rank", "doc_id", "score"]]
    assert len(got) == 400
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, expected.values.tolist()))
