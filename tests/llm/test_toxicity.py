import random
import zlib

import pytest

from pairloom.llm import registry
from pairloom.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def noise(rng):
    return [rng.choice("the of and ing ent tion ea nd".split()) + rng.choice("ea re an st".split()) for _ in range(rng.randint(3, 20))]


@pytest.fixture(scope="module")
def pairs(spark):
    """Marks a, b and groups g, h: toxic are a with g and b with h; a with h, b with g and all else is clean."""
    rng, docs, labels = random.Random(5), [], []
    for i in range(900):
        kind = i % 6
        marks = [["fool", "tallfolk"], ["oaf", "shortfolk"], ["fool", "shortfolk"], ["oaf", "tallfolk"], [], []][kind]
        words = noise(rng) + marks
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(kind < 2)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), {i: t for i, _, t in labels}


def test_learns_pairs_of_terms_that_no_sum_of_weights_tells_apart(pairs):
    docs, labels, truth = pairs
    rows = T.score(docs, labels).collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == 900 and len(unseen) > 120
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_labels_never_matter(pairs, spark):
    docs, labels, _ = pairs
    wrong = spark.createDataFrame([(r.doc_id, 1, 1 - r.toxic if held(r.doc_id) else r.toxic) for r in labels.collect()], LABELS)
    some = docs.where("doc_id < 300")
    assert sorted(T.score(some, labels).collect()) == sorted(T.score(some, wrong).collect())


def test_held_out_accuracy_on_the_supplied_documents(spark):
    rows = {r.doc_id: r for r in registry.op11_toxicity(spark, "/root/testdata/sf0.1").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert all(r.held_out == held(d) for d, r in rows.items())
    unseen = [(rows[t.doc_id].predicted, t.toxic) for t in truth if held(t.doc_id)]
    toxic, clean = [p for p, t in unseen if t], [p for p, t in unseen if not t]
    assert sum(toxic) / len(toxic) > 0.85
    assert sum(clean) / len(clean) < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a word"), (1, "a word"), (None, None), (3, ""), (4, "x" * 200_000 + " 42 !")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "1 as label", "2 as score", "3 as terms", "4 as _id", "5 as features")
    for labels, expected in (([], 0.0), ([(1, 0, 0)], 0.0), ([(1, 0, 1), (None, 0, 0), (4, 0, None), (77, 0, 0)], 1.0)):
        rows = T.score(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 3, 4]
        assert {r.score for r in rows} == {expected}, labels
    assert T.score(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    assert [r.held_out for r in T.score(docs.where("doc_id is null"), spark.createDataFrame([], LABELS)).collect()] == [False]


def test_sample_is_bounded_and_takes_one_text_an_id(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text").union(spark.range(3000).selectExpr("7L", "'t'"))
    labels = spark.range(4000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic")
    rows = T.sample(docs, labels, "doc_id", "text", "toxic", 500).collect()
    assert 400 < len(rows) < 600 and len({r._id for r in rows}) == len(rows)
    assert not any(held(r._id) for r in rows)
