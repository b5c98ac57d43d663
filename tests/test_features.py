"""Steps that are fit on train rows, nested records, names and sources, on small tables."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from pairloom.functions import text as X
from pairloom.operators import features as E
from pairloom.operators import network as N
from pairloom.operators import splits as S
from pairloom.operators import statistics as T
from pairloom.sources import catalog, files


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_folding_equals_decomposition(spark):
    texts = ["Ménière", "š ő ł-like ﬁ ① ½ ㎏", "ＡＢＣ ｘ", "𝐁𝐨𝐥𝐝 …", "中文 é", "", None, "".join(chr(c) for c in range(0xA0, 0x2100)), "ǆ ㈱ ℡ Ⅷ"]
    want = [t and unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert values(spark, X.ascii_fold, *texts) == want


def test_names_and_figures(spark):
    assert values(spark, X.drug_name, ".alpha.-Tocopherol (+/-)", "(-)-X", "()", None, "Æ", "a(RS)b(rs)") == ["alphatocopherol", "x", None, None, None, "ab"]
    assert values(spark, X.name_keys, "Aspirin (JP18/USP); Acetyl salicylic (INN);;aspirin (TN)", None) == [["acetylsalicylic", "aspirin"], None]
    assert values(spark, lambda c: X.without_prefix(c, "NCBIGene:", "g."), "NCBIGene:5", "g.x", "5", None) == ["5", "x", "5", None]
    assert values(spark, X.clamped, "0.5", "2", "-1", "nan", "x", "inf", None) == [0.5, 1.0, 0.0, None, None, None, None]
    text = "Enzyme: CYP3A4 [HSA:1576], cyp [HSA:1]; CYP1A2[HSA:2] Transporter: ABCB1 [HSA:5243]"
    assert values(spark, lambda c: X.gene_tokens(X.section(c, "Enzyme:", "Transporter:")), text, "none") == [["CYP1A2", "CYP3A4"], []]
    assert values(spark, lambda c: X.gene_tokens(X.section(c, "Transporter:")), text) == [["ABCB1"]]


def test_levels_come_from_train(spark):
    train = spark.createDataFrame([(v,) for v in "aaabbcd"] + [(None,)], "v string")
    assert E.fit_levels(train, "v", 9) == ["a", "b", "c", "d"] and E.fit_levels(train, "v", 3, bucket_tail=False) == []
    levels = E.fit_levels(train, "v", 3)
    assert levels == ["a", "b", "other"]
    held = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    rows = E.level_columns(held, "v", levels, "p").select("p_a", "p_b", "p_other", "p___missing__").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 0, 1), (0, 0, 1, 0), (1, 0, 0, 0)]


def test_medians_and_effects_come_from_train(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    held = spark.createDataFrame([(None, 5.0), (float("nan"), None)], "a double, b double")
    assert sorted(map(tuple, E.fill_medians(held, E.fit_medians(train, ["a", "b"])).collect())) == [(2.0, 0.0), (2.0, 5.0)]
    rows = [(i, j, 10.0 + i - 2 * j) for i in range(5) for j in range(4) if (i * j) % 3 != 1]
    pairs = spark.createDataFrame(rows, "d int, c int, v double")
    effects = T.fixed_effects(pairs, "d", "c", "v")
    assert max(abs(r.residual) for r in T.apply_effects(pairs, effects, "d", "c", "v").collect()) < 1e-6
    new = T.apply_effects(spark.createDataFrame([(9, 0, 1.0), (0, 9, 1.0)], "d int, c int, v double"), effects, "d", "c", "v").collect()
    assert {(r.d, r.d_unseen, r.c_unseen) for r in new} == {(9, True, False), (0, False, True)}
    assert all(r.d_offset == 0 for r in new if r.d == 9)


def test_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 5, 6, 99, None)], "n int")
    got = {r.n: r.b for r in df.select("n", E.bucket(F.col("n"), E.NEIGHBOURS, "none").alias("b")).collect()}
    assert got == {0: "0", 1: "1-2", 2: "1-2", 3: "3-5", 5: "3-5", 6: "6+", 99: "6+", None: "none"}


def test_floor_table_says_what_is_skipped(spark):
    rows = spark.createDataFrame([(d, c, int((d + c) % 3 == 0), 0) for d in range(4) for c in range(6)], "drug int, condition int, y int, none int")
    out = E.floor_table({"all": (rows, rows), "gone": None}, ["y", "none", "other"], (2,)).collect()
    status = {(r.population, r.label): r.status for r in out}
    assert status["all", "y"] == "ok" and status["all", "none"] == "skipped: single class in train"
    assert status["all", "other"] == "skipped: label column not present" and status["gone", "y"] == "skipped: population not available"


def test_invariants_and_descriptions(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "k int, y int")
    assert E.same_rows(df, df) is df and E.near_rate(df, "y", 0.5, 0.01) == 0.5
    for bad in (lambda: E.same_rows(df, df.limit(1)), lambda: E.near_rate(df, "y", 0.9, 0.1), lambda: T.dictionary(df, "t", {"k": "key"}), lambda: S.resplit(df.selectExpr("k drug"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "drug int, group_key string"))):
        with pytest.raises(ValueError):
            bad()
    assert {r.column: r.description for r in T.dictionary(df, "t", {"k": "key"}, [("y.*", "label")]).collect()} == {"k": "key", "y": "label"}


def test_swapped_edges_keep_degrees(spark):
    edges = spark.createDataFrame([(i % 12, (i * 7 + i // 12) % 15) for i in range(90)], "a int, b int").distinct()
    new = T.swap_edges(edges, "a", "b", rounds=3)
    for k in ("a", "b"):
        before, after = (sorted(map(tuple, e.groupBy(k).count().collect())) for e in (edges, new))
        assert before == after
    assert new.distinct().count() == edges.count() and new.exceptAll(edges).count() > 10


def test_chain_needs_few_rounds(spark, monkeypatch):
    rounds = []
    keep = N.keep
    monkeypatch.setattr(N, "keep", lambda df, name="step": rounds.append(name) or keep(df, name))
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(900, 900), (901, 902), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in N.connected(chain, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(501)}, 900: 900, 901: 901, 902: 901}
    assert len(rounds) <= 11


def test_numbers_and_sums(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "v int, k int").repartition(5)
    assert sorted((r.row_index, r.v) for r in catalog.numbered(df, ["v"]).collect()) == [(i, i) for i in range(101)]
    assert sorted((r.row_index, r.v) for r in catalog.numbered(df, [F.desc("v")]).collect()) == [(i, 100 - i) for i in range(101)]
    rows = sorted((r.k, r.v, r.s) for r in catalog.prefix_sums(df, "k", "v", {"s": "v"}).collect())
    assert all(s == sum(v2 for k2, v2, _ in rows if k2 == k and v2 < v) for k, v, s in rows)
    sizes = {r.tile: r["count"] for r in catalog.tiles(df, ["v"], 4).groupBy("tile").count().collect()}
    assert sizes == {1: 26, 2: 25, 3: 25, 4: 25}


def test_records_of_any_line_end(spark, tmp_path):
    obo = "format-version: 1.2\r\n\r\n[Term]\r\nid: A:1\r\nname: one\r\nis_a: B:2 ! two\r\n\r\n[Term]\r\nid: B:2\r\nname: two\r\n"
    (tmp_path / "a.obo").write_bytes(obo.encode())
    assert {(r.term_id, r.name, tuple(r.parents)) for r in files.obo_terms(spark, f"{tmp_path}/a.obo").collect()} == {("A:1", "one", ("B:2",)), ("B:2", "two", ())}
    flat = "ENTRY       D1  Drug\nNAME        a ///b\n            c\n            d\n///\nENTRY       D2\nNAME        x\n///\n"
    (tmp_path / "f.txt").write_text(flat)
    assert {(r.entry, r.field, tuple(r.lines)) for r in files.flat_records(spark, f"{tmp_path}/f.txt").collect()} >= {("D1", "NAME", ("a ///b", "c", "d")), ("D2", "NAME", ("x",))}


def test_sinks_conform(spark, tmp_path):
    schema = StructType().add("k", LongType()).add("s", StringType()).add("gone", StringType())
    df = spark.createDataFrame([("1", "a", 9), ("x", 'b "q", c', 9)], "K string, s string, other int")
    for kind in ("parquet", "csv", "tsv", "json"):
        files.write(df, f"{tmp_path}/{kind}", kind, schema)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/parquet").collect()), key=str) == [(1, "a", None), (None, 'b "q", c', None)]
    assert {r.s for r in files.strings_csv(spark, f"{tmp_path}/csv").collect()} == {"a", 'b "q", c'}


def test_cached_tables_are_forgotten(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame([(1, "a")], "k int, s string").write.parquet(path)
    held = catalog.cached(spark, path)
    assert held.count() == 1 and held.storageLevel.useMemory
    catalog.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"), path)
    assert catalog.load(spark, path).count() == 2


def test_search_takes_text_literally(spark):
    df = spark.createDataFrame([("Alpha (x)",), ("alphax",), (None,), ("beta",)], "name string")
    assert [r.name for r in catalog.search(df, "name", "PHA (X").collect()] == ["Alpha (x)"]
    assert catalog.search(df, "name", ".").collect() == [] and len(catalog.search(df, "name", "a", 2).collect()) == 2


def test_a_frequent_code_is_dealt_over_tasks(spark, monkeypatch):
    """All pairs of one code, in several tasks of a bounded number of pairs."""
    from pairloom.operators import features as E

    for name, size in (("IDS_A_CELL", 20), ("GENES_A_CELL", 10), ("PAIRS_A_TASK", 500)):
        monkeypatch.setattr(E, name, size)
    xrefs = spark.createDataFrame([(f"t{k}", "OMIM", "7") for k in range(100)] + [("u", "OMIM", "8"), ("w", "MESH", "7")], "id string, source string, code string")
    genes = spark.createDataFrame([("OMIM:7", k, "M") for k in range(60)] + [("OMIM:8", 5, "M")] * 2 + [("OMIM:9", 6, "M")], "disease string, gene int, association string")
    out = E.genes_by_code(xrefs, genes)
    want = [(f"t{k}", g, "M") for k in range(100) for g in range(60)] + [("u", 5, "M")] * 2
    assert sorted(map(tuple, out.collect())) == sorted(want)
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 3000


def test_widened_sets_are_told_apart_in_bounded_tasks(spark, monkeypatch):
    from pairloom.operators import network as N

    monkeypatch.setattr(N, "ROWS_A_PART", 100)
    members = spark.createDataFrame([(f"s{k % 3}", k) for k in range(300)], "set_id string, condition int")
    mapping = spark.createDataFrame([(k, f"o{k // 6}") for k in range(300)] + [(k, "all") for k in (0, 1)], "condition int, ontology_id string")
    out = N.widened(members, mapping)
    assert sorted(map(tuple, out.collect())) == sorted((f"s{j}", k) for j in range(3) for k in range(300))
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 6 and max(r["count"] for r in parts) < 200


def test_folding_looks_for_no_character_in_a_list(spark):
    from pairloom.functions import text as X

    out = spark.createDataFrame([("\u00e9\u4e2d\ufb01x" * 50,)], "t string").select(X.ascii_fold(F.col("t")))
    assert out.first()[0] == "efix" * 50
    assert "[" + "".join(X._MANY)[:8] not in out._jdf.queryExecution().analyzed().toString()
