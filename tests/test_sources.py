import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pairloom.sources import catalog, files
from pairloom.streaming import logs

OBO = """format-version: 1.2

[Term]
id: HP:1
name: Root
synonym: "Base" EXACT []
synonym: "Wide" BROAD []
xref: SCTID:5 {source="x"}

[Term]
id: HP:2
name: Leaf
is_a: HP:1 ! Root
is_obsolete: true
replaced_by: HP:1

[Typedef]
id: part_of
"""


def test_formats(spark, tmp_path):
    (tmp_path / "t.obo").write_text(OBO)
    terms = {r.term_id: r for r in files.obo_terms(spark, f"{tmp_path}/t.obo", scopes=("EXACT", "NARROW")).collect()}
    assert terms["HP:1"].synonyms == ["Base"] and terms["HP:1"].xrefs == ["SCTID:5"] and terms["HP:2"].parents == ["HP:1"]
    assert terms["HP:2"].is_obsolete and terms["HP:2"].replaced_by == "HP:1" and len(terms) == 2
    assert files.obo_terms(spark, f"{tmp_path}/t.obo", keep_obsolete=False).count() == 1
    (tmp_path / "k.txt").write_text("ENTRY       D1     Drug\nNAME        one;\n            two\nTARGET      X\n///\nENTRY       D2     Drug\n///\n")
    got = {(r.entry, r.field): r.lines for r in files.flat_records(spark, f"{tmp_path}/k.txt").collect()}
    assert got["D1", "NAME"] == ["one;", "two"] and ("D2", "ENTRY") in got
    (tmp_path / "m.tsv").write_text("# note\na\tb\n1\t2\n")
    assert [tuple(r) for r in files.strings_csv(spark, f"{tmp_path}/m.tsv", ["b"], "\t", "#").collect()] == [("2",)]


def test_tolerant_reads(spark, tmp_path):
    schema = StructType([StructField("i", IntegerType()), StructField("s", StringType())])
    assert files.tolerant_csv(spark, f"{tmp_path}/none.csv", schema).collect() == []
    (tmp_path / "a.csv").write_text("i,s\n1,x\nbad,y\n3,z\n")
    assert sorted(r.i for r in files.tolerant_csv(spark, f"{tmp_path}/a.csv", schema).collect() if r.i) == [1, 3]
    df = spark.createDataFrame([("1.0", " a "), ("x", ""), (None, None)], "n string, t string")
    assert [r.n for r in files.whole_rows(df, "n").collect()] == [1] and [r.t for r in files.text_rows(df, "t").collect()] == ["a"]
    assert files.whole_rows(df, "missing").collect() == []
    (tmp_path / "l.json").write_text('{"id": "1"}\nnot json\n{"id": "2"}\n')
    assert sorted(r.id for r in files.records(spark, f"{tmp_path}/l.json", "id string").collect()) == ["1", "2"]


def test_checked_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "yes"), (9, "yes"), (1, "??")], "drug int, vote string")
    refused = files.append_checked(rows, f"{tmp_path}/votes", {"drug": spark.createDataFrame([(1,)], "drug int")}, {"vote": ("yes", "no")})
    assert sorted(r.reason for r in refused.collect()) == ["bad vote", "unknown drug"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/votes").count() == 1


def test_registry_pages_and_edits(spark, tmp_path):
    (tmp_path / "derived").mkdir()
    (tmp_path / "derived" / "b.csv").write_text('x,y\n1,"two\nlines"\n')
    spark.createDataFrame([(i, None if i == 2 else "v") for i in range(30)], "k int, s string").write.parquet(f"{tmp_path}/t.parquet")
    found = {t["name"]: t for t in catalog.tables(spark, str(tmp_path))}
    assert found["derived__b"]["read_only"] and found["derived__b"]["rows"] == 1 and found["t"]["rows"] == 30
    rows = catalog.numbered(catalog.load(spark, f"{tmp_path}/t.parquet").withColumn("n", F.col("k").cast("int")), ["n"]).drop("n")
    page = catalog.page(rows, 2, 3).orderBy("row_index").collect()
    assert [(r.row_index, r.k, r.s) for r in page] == [(2, "2", ""), (3, "3", "v"), (4, "4", "v")]
    for bad in ((-1, 5), (0, 0), (0, 501)):
        with pytest.raises(ValueError):
            catalog.page(rows, *bad)
    with pytest.raises(ValueError):
        catalog.edited(rows, spark.createDataFrame([(30, "k", "1", 1)], "row_index long, column string, value string, seq int"))
    new = catalog.edited(rows, spark.createDataFrame([(2, "s", "e", 1), (2, "zz", "e", 2)], "row_index long, column string, value string, seq int"))
    catalog.replace(new, f"{tmp_path}/t.parquet")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").where("s = 'e'").count() == 1


def test_stream_scores_once(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for batch in ([(1,), (2,), (2,)], [(2,), (3,)]):
        spark.createDataFrame(batch, "k int").write.mode("append").parquet(source)
        logs.score_stream(spark, source, "k int", ["k"], lambda df: df.withColumn("score", F.col("k") * 10), out, f"{tmp_path}/cp").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 10), (2, 20), (3, 30)]


def test_log(spark, tmp_path):
    events = [{"id": "a", "event": "register", "label": "x"}, {"id": "a", "event": "complete", "metric": 1.0}, {"id": "b", "event": "register", "label": "x"}, {"id": "b", "event": "complete", "metric": 2.0, "failed": True}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n{bad\n")
    board = logs.leaderboard(files.records(spark, f"{tmp_path}/e.jsonl", logs.EVENT), "x").collect()
    assert [(r.id, r.rank) for r in board] == [("a", 1)]
    seen = []
    runs = logs.run_stages([("one", lambda: None), ("two", lambda: 1 / 0), ("three", lambda: None)], seen.append)
    assert [r["status"] for r in runs] == ["ok", "failed"] == [r["status"] for r in seen]


def test_projected_scan(spark, tmp_path):
    for part in range(2):
        spark.createDataFrame([(i % 3, f"v{i}", i) for i in range(6)], "k int, name string, other int").write.parquet(f"{tmp_path}/{part}.parquet")
    df = files.scan(spark, [f"{tmp_path}/0.parquet", f"{tmp_path}/1.parquet"], {"name": "label"}, "k", [1])
    assert sorted(r.label for r in df.collect()) == ["v1", "v4"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan and "PushedFilters: [In(k, [1])" in plan.replace("IsNotNull(k), EqualTo(k,1)", "In(k, [1]") or "EqualTo(k,1)" in plan
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert files.json_array(spark, f"{tmp_path}/a.json", "x int").count() == 2
