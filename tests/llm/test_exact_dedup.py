import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "a", "A", "a ", "é", "long " * 9000, f"u{i}"])) for i in range(300)]
    rows += [(1000 + i, "hot") for i in range(400)]
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    for radix, lane_rows in ((16, 1 << 20), (2, 100)):  # 16 lanes in one round; 8 in three
        assert sorted(map(tuple, E.mark_copies(docs.repartition(5), radix=radix, lane_rows=lane_rows).collect())) == brute(rows)
    left = E.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_runs_merge_across_batches():
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("length", pa.int32()), ("check", pa.int64()), pa.field("n", pa.int64(), nullable=False)])
    rng = random.Random(2)
    rows = sorted((bytes([rng.randrange(9)]), i) for i in range(200))
    batches = [pa.RecordBatch.from_pylist([dict(doc_id=i, digest=d, length=1, check=0, n=1) for d, i in rows[at : at + 7]], schema=schema) for at in range(0, 200, 7)]
    got = [(r["digest"], r["doc_id"], r["n"]) for b in E.merge_run(iter(batches)) for r in b.to_pylist()]
    assert got == [(d, max(i for e, i in rows if e == d), sum(e == d for e, _ in rows)) for d in sorted({d for d, _ in rows})]


def test_one_digest_has_a_row_for_each_lane(spark):
    """After the first merge a text that most rows hold has at most one row in each of the lanes that meet."""
    docs = spark.range(4000).selectExpr("id doc_id", "if(id % 10 > 0, 'hot', cast(id as string)) text").repartition(8)
    rows = E.digested(docs, "doc_id", "text").withColumn("lane", F.pmod("part", F.lit(4)))
    first = rows.select("doc_id", *E.KEY, "lane", F.col("lane").alias("home"), F.lit(1).cast("long").alias("n"))
    runs = E.run_of_lanes(first, 4)
    assert runs.groupBy("digest", "lane").count().where("count > 1").isEmpty() and runs.groupBy("digest").count().agg(F.max("count")).first()[0] == 4
    for k in range(2):
        runs = E.exchange(runs, k, 2, 2)
        assert runs.groupBy("digest").count().agg(F.max("count")).first()[0] == 2 >> k
    assert runs.agg(F.sum("n")).first()[0] == 4000


def test_clashing_columns_come_back_unchanged(spark):
    names = ["_id", "_digest", "_row", "_copy", "_a", "_B", "lane", "n", "part", "digest", "a.b"]
    docs = spark.createDataFrame([(i, "same" if i < 3 else f"t{i}", *[f"{c}{i}" for c in names]) for i in range(6)], ["doc_id", "text", *names])
    left = E.drop_copies(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id > 1)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "z"), (None, "z")], "doc_id long, text string")
    rows = E.mark_copies(docs).collect()
    assert len(rows) == 6 and sum(r.kept for r in rows) == 3
    assert sorted((r.doc_id or 0, r.text) for r in E.drop_copies(docs).collect()) == [(0, "z"), (1, "a"), (1, "b")]
    assert E.mark_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_several_rounds_and_lanes_by_rows(spark, monkeypatch):
    rounds, real = [], E.exchange
    monkeypatch.setattr(E, "exchange", lambda runs, k, *a: rounds.append(k) or real(runs, k, *a))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = E.mark_copies(docs).collect()
    assert rounds == [0, 1, 2, 3] and len(rows) == 10_000
    assert sorted(map(tuple, rows)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    # one input partition fills all lanes
    seen, merge = [], E.run_of_lanes
    monkeypatch.setattr(E, "run_of_lanes", lambda rows, lanes: seen.append(rows) or merge(rows, lanes))
    one = spark.range(1000).selectExpr("id doc_id", "cast(id as string) text").coalesce(1)
    assert E.mark_copies(one, lane_rows=50).count() == 1000
    assert max(r["count"] for r in seen[0].groupBy("lane").count().collect()) <= 100
