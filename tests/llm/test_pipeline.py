import corpus_pipeline
from pairloom.llm import packing, quality_rules, registry
from tests.llm.test_jaccard import brute as near
from tests.llm.test_quality_rules import brute as measures


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, out = docs.columns, [{r.doc_id: r.text for r in docs.collect()}], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
            kept.append({r.doc_id: r.text for r in out.collect()})
    raw, good, once, apart, mixed = kept
    assert set(good) <= set(raw) and not any(measures(t)[5] for t in good.values())
    largest = {}
    for d, t in good.items():
        largest[t] = max(d, largest.get(t, d))
    assert set(once) == set(largest.values())
    assert set(apart) == {d for d, (_, c) in near(list(once.items())).items() if d == c}
    assert set(mixed) <= set(apart)
    rows = spark.read.parquet(f"{tmp_path}/3").collect()
    times = {d: sum(r.doc_id == d for r in rows) for d in mixed}
    encoder = packing.encoder(registry.tokenizer_path())
    assert sum(r.length for r in out.collect()) == sum(n * (len(encoder.whole(mixed[d])) // 4 + 1) for d, n in times.items())
    assert list(quality_rules.RULES) and max(times.values()) <= 2


def test_stages_take_nulls_repeats_and_clashes(spark, tmp_path):
    """Every stage on rows of null ids, texts and sources, repeated rows and names that the operators use inside."""
    good = " ".join(f"word{i}" for i in range(60))
    names = ["lang", "n_chars", "_at", "_a", "digest", "sig", "n", "part", "component_id"]
    rows = [(1, good, "a"), (1, good, "a"), (None, good + " end", None), (None, good + " end", None), (3, None, "a"), (4, "", None), (5, good.replace("word7 ", "x "), "b"), (6, " ".join(f"w{i}z" for i in range(30_000)), "b")]
    docs = spark.createDataFrame([(*r, *[f"{c}{i}" for c in names]) for i, r in enumerate(rows)], ["doc_id", "text", "source", *names])
    counts, out = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, out.limit(0), "").count() == 0
        stage(spark, out, "").write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or out.columns == docs.columns
        counts.append(out.count())
    # null and empty texts go; repeats become one; 5 is near 1, a null id links with nothing
    assert counts[:3] == [6, 4, 3] and counts[3] >= 3
    given = {tuple(r)[3:]: tuple(r)[:3] for r in docs.collect()}
    assert all(given[tuple(r)[3:]] == tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/3").collect())


def test_stages_leave_no_shuffle_files(spark, sf_dir, monkeypatch):
    from glob import glob

    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {x for d in folders for x in glob(f"{d}/*/shuffle_*.data")}
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] == "exact dedup"])
    before = files()
    out = corpus_pipeline.run(spark, sf_dir)
    assert not files() - before
    assert out.count() > 0
