"""Queries of features that are fit on train rows, of nested records, and of tables of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import features as E
from ..operators import joins as J
from ..operators import metrics as R
from ..operators import network as N
from ..operators import splits as S
from ..operators import statistics as T
from . import analysis as A
from . import base as B
from .base import r6

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query, and its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def folds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scored pairs of train drugs and of the others."""
    df, train = B.scored(spark, d), B.train_drugs(spark, d)
    return df.join(train, "drug", "left_semi"), df.join(train, "drug", "left_anti")


@query(f"WITH {B.PAIR_SQL} SELECT drug, condition, CAST(coalesce(prr >= 2, false) AS INT) AS prr2, CAST(coalesce(prr >= 4 AND case_count >= 5, false) AS INT) AS prr4_c5, CAST(case_count >= 10 AS INT) AS cases10 FROM sc")
def alternative_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.alternative_labels(B.scored(spark, d)).select("drug", "condition", "prr2", "prr4_c5", "cases10")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey END AS gene, p_size % 3 = 0 AS disease FROM part")
def prefixed_ids(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    raw = F.when(size % 4 == 0, F.concat(F.lit("OTHER:"), key)).otherwise(F.concat(F.lit("NCBIGene:"), key))
    term = F.concat(F.when(size % 3 == 0, "Orphanet:").otherwise("HP:"), key)
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.whole(X.without_prefix(raw, "NCBIGene:")).alias("gene"), E.is_disease(term).alias("disease"))


@query("""WITH m AS (SELECT p_partkey AS molecule, p_partkey // 4 * 4 AS parent, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE p_type END AS kind,
        CASE WHEN p_size > 30 THEN p_size END AS mass, CASE WHEN p_size % 2 = 0 THEN p_size % 4 = 0 END AS oral, CASE WHEN p_size % 5 = 0 THEN true END AS topical,
        CASE WHEN p_size % 6 > 0 THEN [p_brand[-1:] || substr(p_type, 1, 5), p_type] ELSE [] END AS classes FROM part),
    j AS (SELECT m.molecule, coalesce(nullif(m.kind, ''), p.kind) AS kind, coalesce(m.mass, p.mass) AS mass, coalesce(m.oral, p.oral) AS oral, coalesce(m.topical, p.topical) AS topical, CASE WHEN len(m.classes) > 0 THEN m.classes ELSE p.classes END AS classes FROM m JOIN m p ON p.molecule = m.parent)
    SELECT molecule, kind, mass, CASE WHEN oral IS NOT NULL OR topical IS NOT NULL THEN coalesce(CAST(oral AS INT), 0) + coalesce(CAST(topical AS INT), 0) END AS n_routes, CAST(len(classes) AS INT) AS n_classes,
        array_to_string(list_sort(list_distinct(list_transform(classes, lambda x: substr(x, 1, 1)))), '|') AS class_1, array_to_string(list_sort(list_distinct(list_transform(classes, lambda x: substr(x, 1, 4)))), '|') AS class_4, coalesce(mass <= 40, false) AS light FROM j""")
def molecule_block(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    rows = B.table(spark, d, "part").select(
        F.col("p_partkey").alias("molecule"),
        (F.floor(F.col("p_partkey") / 4) * 4).alias("parent_id"),
        F.when(size % 3 == 0, F.lit(None)).when(size % 3 == 1, "").otherwise(F.col("p_type")).alias("kind"),
        F.when(size > 30, size).alias("mass"),
        F.when(size % 2 == 0, size % 4 == 0).alias("oral"),
        F.when(size % 5 == 0, F.lit(True)).alias("topical"),
        F.when(size % 6 > 0, F.array(F.concat(F.substring("p_brand", -1, 1), F.substring("p_type", 1, 5)), "p_type")).otherwise(F.array().cast("array<string>")).alias("classes"),
    )
    out = E.molecules(rows, rows.drop("parent_id"), ["kind", "mass"], ["oral", "topical"])
    return out.select("molecule", "kind", "mass", "n_routes", "n_classes", "class_1", "class_4", E.within_limits({"mass": 40}).alias("light"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'CYP' || p_size || '|' || upper(substr(p_type, 1, 5)) ELSE upper(substr(p_type, 1, 5)) END AS enzymes, 'T' || p_size AS transporters, p_size = 6 AS is_cyp6, substr(p_name, 1, 7) AS short FROM part""")
def entry_tokens(spark: SparkSession, d: str) -> DataFrame:
    size, kind = F.col("p_size"), F.upper(F.substring("p_type", 1, 5))
    cyp = F.when(size % 2 == 0, F.concat(F.lit("CYP"), size.cast("string"), F.lit(" [HSA:1], "))).otherwise(F.lit(""))
    text = F.concat(F.lit("Enzyme: "), cyp, kind, F.lit("[HSA:2] "), kind, F.lit(" [HSA:2]; plain word\nTransporter: T"), size.cast("string"), F.lit(" [HSA:3]"))
    enzymes = X.gene_tokens(X.section(text, "Enzyme:", "Transporter:"))
    return B.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.array_join(enzymes, "|").alias("enzymes"),
        F.array_join(X.gene_tokens(X.section(text, "Transporter:")), "|").alias("transporters"),
        F.array_contains(enzymes, "CYP6").alias("is_cyp6"),
        X.shortened(F.col("p_name"), 7).alias("short"),
    )


LEVEL_SQL = f"""{B.TRAIN_SQL}, sn AS (SELECT s_suppkey AS drug, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'n' || (s_nationkey % 9) END AS v FROM supplier),
    tp AS (SELECT v FROM sn JOIN tr USING (drug) WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 3)"""


@query(f"WITH {LEVEL_SQL} SELECT drug, CASE WHEN v IS NULL THEN '__missing__' WHEN v IN (SELECT v FROM tp) THEN v ELSE 'other' END AS level, CAST(1 AS INT) AS n_hot FROM sn")
def train_levels(spark: SparkSession, d: str) -> DataFrame:
    """The one level that is set of each drug; levels are those of train drugs."""
    rows = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("n"), (F.col("s_nationkey") % 9).cast("string"))).alias("v"))
    levels = E.fit_levels(rows.join(B.train_drugs(spark, d), "drug", "left_semi"), "v", 4)
    out = E.level_columns(rows, "v", levels, "v")
    hot = [c for c in out.columns if c.startswith("v_")]
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == 1, c[2:]) for c in hot])), "+")
    return out.select("drug", named.alias("level"), sum(F.col(f"`{c}`") for c in hot).alias("n_hot"))


@query(f"WITH {B.TRAIN_SQL}, x AS (SELECT s_suppkey AS drug, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS a FROM supplier) SELECT drug, coalesce(a, (SELECT median(a) FROM x JOIN tr USING (drug))) AS a, a IS NULL AS a_missing, CAST(0 AS DOUBLE) AS b FROM x")
def train_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("a"), F.lit(None).cast("double").alias("b"))
    medians = E.fit_medians(rows.join(B.train_drugs(spark, d), "drug", "left_semi"), ["a", "b"])
    return E.fill_medians(rows, medians, flag=True).select("drug", "a", "a_missing", "b")


@query(f"WITH {A.NEIGHBOUR_SQL} SELECT CASE WHEN n_neighbours = 0 THEN '0' WHEN n_neighbours < 3 THEN '1-2' WHEN n_neighbours < 6 THEN '3-5' ELSE '6+' END AS neighbours, count(*) AS n, CAST(sum(n_flagged) AS BIGINT) AS flagged FROM nt GROUP BY 1")
def neighbour_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = A.transported(spark, d)
    return rows.groupBy(E.bucket(F.col("n_neighbours"), E.NEIGHBOURS).alias("neighbours")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_flagged").alias("flagged"))


@query(f"WITH {B.PAIR_SQL} SELECT drug, count(DISTINCT gene) AS n_genes, round(ln(1 + count(DISTINCT gene)), 6) AS log_n_genes FROM li GROUP BY 1")
def distinct_degrees(spark: SparkSession, d: str) -> DataFrame:
    return L.degrees(B.lines(spark, d), "drug", "n_genes", "gene").withColumn("log_n_genes", r6(F.col("log_n_genes")))


@query(f"WITH {B.PAIR_SQL}, {B.GENE_SQL}, n AS (SELECT condition, count(*) AS n_genes FROM cg GROUP BY 1) SELECT condition, n_genes, round(ln((SELECT count(*) FROM n) / (count(*) OVER (PARTITION BY n_genes))::DOUBLE), 6) AS weight FROM n")
def count_weights(spark: SparkSession, d: str) -> DataFrame:
    per = B.condition_genes(spark, d).groupBy("condition").agg(F.count(F.lit(1)).alias("n_genes"))
    return E.count_weight(per, "n_genes", "weight").withColumn("weight", r6(F.col("weight")))


CONDITION_SQL = "cd AS (SELECT p_partkey AS condition, CASE WHEN p_size % 5 = 0 THEN '0_unmatched' ELSE '2_label_exact' END AS tier, CASE WHEN p_size % 3 > 0 THEN p_size % 3 - 1 END AS n_genes, p_name AS gene FROM part)"


@query(f"WITH {B.PAIR_SQL}, {B.GENE_SQL}, {CONDITION_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE tier <> '0_unmatched') AS mapped, count(*) FILTER (WHERE n_genes > 0) AS with_genes, (SELECT count(DISTINCT condition) FROM cd WHERE gene IN (SELECT gene FROM dg)) AS with_target FROM cd")
def coverage_figures(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    conditions = B.table(spark, d, "part").select(F.col("p_partkey").alias("condition"), F.when(size % 5 == 0, "0_unmatched").otherwise("2_label_exact").alias("tier"), F.when(size % 3 > 0, size % 3 - 1).alias("n_genes"), F.col("p_name").alias("gene"))
    return E.coverage(conditions, conditions.select("condition", "gene"), B.drug_genes(spark, d))


@query(f"WITH {B.PAIR_SQL}, {B.GENE_SQL} SELECT (SELECT count(DISTINCT gene) FROM cg) AS n_left, (SELECT count(DISTINCT gene) FROM gp) AS n_right, (SELECT count(DISTINCT gene) FROM gp WHERE gene IN (SELECT gene FROM cg)) AS n_both, round_even(100 * (SELECT count(DISTINCT gene) FROM gp WHERE gene IN (SELECT gene FROM cg)) / (SELECT count(DISTINCT gene) FROM cg)::DOUBLE, 1) AS share")
def overlap_share(spark: SparkSession, d: str) -> DataFrame:
    return E.overlap_share(B.condition_genes(spark, d), B.gene_pathways(spark, d), "gene")


@query(f"""WITH {B.PAIR_SQL}, pn AS (SELECT drug, gene AS target, avg(q) AS affinity FROM li GROUP BY 1, 2), sy AS (SELECT DISTINCT p_brand AS condition, p_name AS target FROM part),
    ct AS (SELECT target, count(*) AS n, median(affinity) AS m, max(affinity) AS top FROM pn GROUP BY 1 HAVING count(*) >= 5),
    mk AS (SELECT target, drug, affinity >= CASE WHEN top >= 25 THEN greatest(25, m) ELSE m END AS hi FROM pn JOIN ct USING (target)),
    rw AS (SELECT target, hi, y FROM sc JOIN mk USING (drug) JOIN sy USING (target, condition))
    SELECT target, round(avg(y) FILTER (WHERE hi), 6) AS rate_hi, round(avg(y) FILTER (WHERE NOT hi), 6) AS rate_lo, count(*) FILTER (WHERE hi) AS n_hi, count(*) FILTER (WHERE NOT hi) AS n_lo FROM rw GROUP BY 1 HAVING count(*) FILTER (WHERE hi) >= 5 AND count(*) FILTER (WHERE NOT hi) >= 5""")
def potency_contrast(spark: SparkSession, d: str) -> DataFrame:
    panel = B.lines(spark, d).groupBy("drug", F.col("gene").alias("target")).agg(F.avg("l_quantity").alias("affinity"))
    sets = B.table(spark, d, "part").select(F.col("p_brand").alias("condition"), F.col("p_name").alias("target")).distinct()
    out = E.potency_contrast(B.scored(spark, d), panel, sets, potent=25.0)
    return out.select("target", r6(F.col("rate_hi")).alias("rate_hi"), r6(F.col("rate_lo")).alias("rate_lo"), "n_hi", "n_lo")


def _floor_sql(name: str, where: str, least: int) -> str:
    return f"""SELECT '{name}' AS population, 'y' AS label, CAST({least} AS INT) AS eligibility, 'ok' AS status, (SELECT round(avg(auc), 6) FROM ({_AUC(where, least)})) AS macro_auc, (SELECT count(*) FROM ({_AUC(where, least)})) AS n_groups, (SELECT round(avg(y), 6) FROM sc WHERE drug IN (SELECT drug FROM tr) AND {where}) AS prevalence"""


def _AUC(where: str, least: int) -> str:
    return f"""SELECT drug, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM (
        SELECT *, rank() OVER (PARTITION BY drug ORDER BY score) + (count(*) OVER (PARTITION BY drug, score) - 1) / 2.0::DOUBLE AS r FROM (
            SELECT s.drug, s.condition, s.y, round(coalesce(p, (SELECT avg(p) FROM (SELECT avg(y) AS p FROM sc WHERE drug IN (SELECT drug FROM tr) AND {where} GROUP BY condition))), 9) AS score FROM sc s LEFT JOIN (SELECT condition, avg(y) AS p FROM sc WHERE drug IN (SELECT drug FROM tr) AND {where} GROUP BY 1) USING (condition)
            WHERE drug NOT IN (SELECT drug FROM tr) AND {where})) GROUP BY 1 HAVING count(*) >= {least} AND sum(y) > 0 AND sum(y) < count(*)"""


@query(f"""WITH {B.PAIR_SQL}, {B.TRAIN_SQL} {_floor_sql('all', 'true', 10)} UNION ALL {_floor_sql('case_count >= 3', 'case_count >= 3', 10)}
    UNION ALL SELECT 'all', 'constant', 10, 'skipped: single class in train', NULL, NULL, NULL UNION ALL SELECT 'case_count >= 3', 'constant', 10, 'skipped: single class in train', NULL, NULL, NULL
    UNION ALL SELECT 'neighbours', l, 10, 'skipped: population not available', NULL, NULL, NULL FROM (VALUES ('y'), ('constant')) v(l)""")
def floor_reference(spark: SparkSession, d: str) -> DataFrame:
    train, held = (f.withColumn("constant", F.lit(0)) for f in folds(spark, d))
    populations = {"all": (train, held), "case_count >= 3": tuple(f.where("case_count >= 3") for f in (train, held)), "neighbours": None}
    out = E.floor_table(populations, ["y", "constant"], (10,))
    return out.withColumns({c: r6(F.col(c)) for c in ("macro_auc", "prevalence")})


@query("""WITH r AS (SELECT s_suppkey AS drug, 'D' || (s_suppkey % 3) AS rung, CASE WHEN s_nationkey % 4 > 0 THEN 'k' || (s_nationkey % 4) END AS kind, s_acctbal AS balance FROM supplier),
    c AS (SELECT rung, coalesce(kind, 'null') AS k, count(*) AS n, row_number() OVER (PARTITION BY rung ORDER BY count(*) DESC, coalesce(kind, 'null')) AS i FROM r GROUP BY 1, 2)
    SELECT rung, count(*) AS n_drugs, count(*) FILTER (WHERE kind = 'k1') AS n_main, round(avg(CAST(coalesce(kind = 'k1', false) AS INT)), 6) AS share_main, round(median(balance), 6) AS median_balance, (SELECT string_agg(k || '=' || n, '|' ORDER BY i) FROM c WHERE c.rung = r.rung AND i <= 3) AS top_kinds FROM r GROUP BY 1""")
def rung_figures(spark: SparkSession, d: str) -> DataFrame:
    supplier = B.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "drug")
    rungs = supplier.select("drug", F.concat(F.lit("D"), (F.col("drug") % 3).cast("string")).alias("rung"))
    drugs = supplier.select("drug", F.when(F.col("s_nationkey") % 4 > 0, F.concat(F.lit("k"), (F.col("s_nationkey") % 4).cast("string"))).alias("kind"), F.col("s_acctbal").alias("balance"))
    out = E.rung_figures(rungs, drugs, "kind", ["balance"], "k1", 3)
    return out.withColumns({c: r6(F.col(c)) for c in ("share_main", "median_balance")})


@query(f"WITH {B.PAIR_SQL} SELECT condition, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg, count(*) >= 10 AND sum(y) > 0 AND sum(y) < count(*) AS qualifies FROM sc GROUP BY 1")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.outcome_counts(B.scored(spark, d), 10)


@query(f"""WITH {B.PAIR_SQL}, lg AS (SELECT 'score' AS scorer, drug, y, score AS s FROM sc UNION ALL SELECT 'cases', drug, y, case_count FROM sc),
    rk AS (SELECT *, rank() OVER (PARTITION BY scorer, drug ORDER BY s) + (count(*) OVER (PARTITION BY scorer, drug, s) - 1) / 2.0::DOUBLE AS r FROM lg),
    au AS (SELECT scorer, drug, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM rk GROUP BY 1, 2 HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*))
    SELECT scorer, round(avg(auc), 6) AS macro_auc, count(*) AS n_groups FROM au GROUP BY 1""")
def scorer_table(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scored(spark, d).select("drug", "y", "score", F.col("case_count").cast("double").alias("cases"))
    return E.scorer_table(rows, ["score", "cases"]).withColumn("macro_auc", r6(F.col("macro_auc")))


@query("SELECT DISTINCT m AS molecule, drug FROM (SELECT 'M' || s_suppkey AS m, s_suppkey AS drug FROM supplier UNION ALL SELECT CASE WHEN s_suppkey % 4 > 0 THEN 'M' || (s_suppkey // 2) END, s_suppkey FROM supplier) WHERE m IS NOT NULL")
def id_routes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    drugs = B.table(spark, d, "supplier").select(key.alias("drug"), F.concat(F.lit("M"), key.cast("string")).alias("own"), F.when(key % 4 > 0, F.concat(F.lit("M"), F.floor(key / 2).cast("string"))).alias("parent"))
    return E.id_routes(drugs, "drug", "own", "parent")


@query(f"""WITH {B.PAIR_SQL} SELECT s_suppkey AS drug, b.condition, round(prr, 6) AS prr, round(CASE WHEN prr > 0 THEN ln(prr) END, 6) AS log_prr
    FROM supplier CROSS JOIN (SELECT DISTINCT p_brand AS condition FROM part) b LEFT JOIN sc ON drug = s_suppkey AND sc.condition = b.condition""")
def incumbent_scores(spark: SparkSession, d: str) -> DataFrame:
    brands = B.table(spark, d, "part").agg(F.collect_set("p_brand").alias("b"))  # brands are few
    pairs = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.explode(brands.scalar()).alias("condition"))
    out = E.incumbent(pairs, B.scored(spark, d), ["drug", "condition"], "prr")
    return out.select("drug", "condition", r6(F.col("prr")).alias("prr"), r6(F.col("log_prr")).alias("log_prr"))


@query(f"WITH {B.PAIR_SQL} SELECT drug, condition, y, s_nationkey AS nation, round(s_acctbal, 2) AS balance, n_parts, d.n AS drug_degree FROM sc JOIN supplier ON drug = s_suppkey JOIN (SELECT p_brand, count(*) AS n_parts FROM part GROUP BY 1) ON p_brand = condition JOIN (SELECT drug, count(*) AS n FROM sc GROUP BY 1) d USING (drug)")
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = B.scored(spark, d).select("drug", "condition", "y")
    drugs = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal", 2).alias("balance"))
    brands = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("condition")).agg(F.count(F.lit(1)).alias("n_parts"))
    degree = L.degrees(pairs, "drug", "drug_degree").drop("log_drug_degree")
    return E.design(pairs, [(drugs, ["drug"]), (brands, ["condition"]), (degree, ["drug"])])


@query("SELECT p_brand AS condition, substr(coalesce(string_agg(DISTINCT t, '|' ORDER BY t), ''), 1, 40) AS events FROM (SELECT p_brand, unnest([p_type, p_name]) AS t FROM part) GROUP BY 1")
def united_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "part").select(F.col("p_brand").alias("condition"), F.concat("p_type", F.lit("||"), "p_name").alias("events"))
    return E.united(rows, "condition", "events", limit=40)


@query("SELECT p_brand AS gene, max(p_size) FILTER (WHERE p_type = 'LARGE') AS tract_large, max(p_size) FILTER (WHERE p_type = 'SMALL') AS tract_small FROM part GROUP BY 1")
def wide_records(spark: SparkSession, d: str) -> DataFrame:
    nested = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.collect_list(F.struct(F.concat(F.lit("Tract "), F.initcap("p_type")).alias("label"), F.col("p_size").alias("value"))).alias("records"))
    return E.wide_records(nested, "gene", "records", E.slug(F.col("r.label")), F.col("r.value"), ["tract_large", "tract_small"])


@query("SELECT DISTINCT p_name AS target, p_partkey AS condition FROM part")
def map_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part").groupBy("p_name").agg(F.collect_list("p_partkey").alias("keys"))
    return E.map_pairs(part.select(F.to_json(F.map_from_arrays(F.array("p_name"), F.array("keys"))).alias("j")), "j", "target", "condition")


@query("""WITH x AS (SELECT 'MONDO:' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'OMIM' WHEN p_size % 3 = 1 THEN 'Orphanet' ELSE 'MESH' END AS source, CAST(p_size AS VARCHAR) AS code FROM part),
    g AS (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'OMIM' ELSE 'Orphanet' END AS source, CAST(s_nationkey AS VARCHAR) AS code, s_suppkey AS gene, 'MENDELIAN' AS association FROM supplier)
    SELECT id, gene, association FROM x JOIN g USING (source, code)""")
def disease_genes(spark: SparkSession, d: str) -> DataFrame:
    size, nation = F.col("p_size"), F.col("s_nationkey")
    xrefs = B.table(spark, d, "part").select(F.concat(F.lit("MONDO:"), F.col("p_partkey").cast("string")).alias("id"), F.when(size % 3 == 0, "OMIM").when(size % 3 == 1, "Orphanet").otherwise("MESH").alias("source"), size.cast("string").alias("code"))
    genes = B.table(spark, d, "supplier").select(F.concat(F.when(nation % 2 == 0, "OMIM:").otherwise("ORPHA:"), nation.cast("string")).alias("disease"), F.col("s_suppkey").alias("gene"), F.lit("MENDELIAN").alias("association"))
    return E.genes_by_code(xrefs, genes)


@query("SELECT CASE WHEN p_size % 4 = 1 THEN 'EFO:' ELSE 'MONDO:' END || p_size AS disease, count(DISTINCT p_partkey) AS n_phenotypes FROM part WHERE p_size % 4 > 0 AND p_partkey % 3 > 0 GROUP BY 1")
def phenotype_counts(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    rows = B.table(spark, d, "part").select(F.concat(F.when(size % 4 == 0, "GO_").when(size % 4 == 1, "EFO_").otherwise("MONDO_"), size.cast("string")).alias("a"), F.concat(F.when(F.col("p_partkey") % 3 > 0, "HP_").otherwise("MP_"), key).alias("b"))
    return E.phenotype_pairs(rows, "a", "b").groupBy("disease").agg(F.count_distinct("phenotype").alias("n_phenotypes"))


@query(f"WITH {A.NEIGHBOUR_SQL} SELECT drug, condition, round((n_flagged + 5 * p_c) / (n_neighbours + 5), 6) AS rate_5, round((n_flagged + 10 * p_c) / (n_neighbours + 10), 6) AS rate_10, round((n_flagged + 20 * p_c) / (n_neighbours + 20), 6) AS rate_20, round((n_flagged + 20 * p_c) / (n_neighbours + 20) - p_c, 6) AS excess_20 FROM nt")
def shrunk_rates(spark: SparkSession, d: str) -> DataFrame:
    out = N.shrunk_rates(A.transported(spark, d))
    return out.select("drug", "condition", *[r6(F.col(c)).alias(c) for c in ("rate_5", "rate_10", "rate_20", "excess_20")])


@query("SELECT p_partkey AS drug, p_name AS gene FROM part WHERE p_type NOT IN ('LARGE', 'SMALL') AND p_size % 4 = 1")
def efficacy_targets(spark: SparkSession, d: str) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size")
    relation = F.when(kind == "LARGE", "protein complex group").when(kind == "SMALL", "PROTEIN FAMILY").when(kind == "PROMO", F.lit(None)).otherwise("SINGLE PROTEIN")
    efficacy = F.when(size % 4 == 1, F.when(size % 8 == 1, "True ").otherwise("1")).when(size % 4 == 2, "0")
    edges = B.table(spark, d, "part").select(F.col("p_partkey").alias("drug"), F.col("p_name").alias("gene"), relation.alias("component"), efficacy.alias("efficacy"))
    return E.target_edges(edges).select("drug", "gene")


@query(f"""WITH {B.PAIR_SQL}, {B.GENE_SQL}, idf AS (SELECT gene, ln((SELECT count(DISTINCT condition) FROM cg) / count(DISTINCT condition)::DOUBLE) AS idf FROM cg GROUP BY 1),
    sh AS (SELECT drug, condition, sum(score) AS s, max(score) AS m, sum(idf) AS i FROM dg JOIN cg USING (gene) JOIN idf USING (gene) GROUP BY 1, 2)
    SELECT drug, condition, coalesce(s, 0) AS sum_score, coalesce(m, 0) AS max_score, round(coalesce(i, 0), 6) AS sum_idf FROM pc LEFT JOIN sh USING (drug, condition)""")
def weighted_overlap(spark: SparkSession, d: str) -> DataFrame:
    genes = B.condition_genes(spark, d)
    weighted = genes.join(N.gene_idf(genes).select("gene", "idf"), "gene")
    out = N.overlap(B.pair_counts(spark, d).select("drug", "condition"), B.drug_genes(spark, d), weighted, "gene", ("score", "idf"))
    return out.select("drug", "condition", F.col("sum_score").cast("double").alias("sum_score"), F.col("max_score").cast("double").alias("max_score"), r6(F.col("sum_idf")).alias("sum_idf"))


_EFFECT_ROUNDS = 12
_EFFECT_SQL = ", ".join(f"e{k + 1} AS (SELECT drug, condition, v - avg(v) OVER (PARTITION BY {('drug', 'condition')[k % 2]}) AS v FROM e{k})" for k in range(2 * _EFFECT_ROUNDS))


@query(f"""WITH {B.PAIR_SQL}, {B.TRAIN_SQL}, t AS (SELECT * FROM sc WHERE drug IN (SELECT drug FROM tr) AND condition <> 'Brand#1'), mu AS (SELECT avg(case_count) AS m FROM t),
    e0 AS (SELECT drug, condition, case_count - m AS v FROM t, mu), {_EFFECT_SQL},
    x AS (SELECT t.drug, t.condition, t.case_count - m - e.v AS fitted FROM t JOIN e{2 * _EFFECT_ROUNDS} e USING (drug, condition), mu),
    co AS (SELECT condition, avg(fitted - da) AS c FROM (SELECT *, avg(fitted) OVER (PARTITION BY drug) AS da FROM x) GROUP BY 1)
    SELECT drug, condition, round(case_count - (SELECT m FROM mu) - coalesce(c - (SELECT avg(c) FROM co), 0), 4) + 0 AS residual, true AS drug_unseen, c IS NULL AS condition_unseen FROM sc LEFT JOIN co USING (condition) WHERE drug NOT IN (SELECT drug FROM tr)""")
def heldout_effects(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of held-out pairs by train's offsets; no held-out drug was seen, and one condition was not."""
    train, held = folds(spark, d)
    effects = T.fixed_effects(train.where("condition <> 'Brand#1'"), "drug", "condition", "case_count")
    # offsets are told apart up to a constant; the conditions' are put to a mean of 0
    mean, drugs, conditions = effects
    conditions = conditions.withColumn("condition_offset", F.col("condition_offset") - conditions.agg(F.avg("condition_offset")).scalar())
    out = T.apply_effects(held, (mean, drugs, conditions), "drug", "condition", "case_count")
    return out.select("drug", "condition", (F.round("residual", 4) + 0).alias("residual"), "drug_unseen", "condition_unseen")


@query(f"""WITH {B.PAIR_SQL}, g AS (SELECT drug, avg(case_count) - avg(score) AS v FROM sc GROUP BY 1), w AS (SELECT b, {B.weight_sql(42, 'b', 'drug')} AS w, v FROM g, range(200) AS r(b)), m AS (SELECT b, sum(w * v) / sum(w) AS m FROM w GROUP BY 1 HAVING sum(w) > 0)
    SELECT round((SELECT avg(v) FROM g), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    df = B.scored(spark, d)
    first, second = (df.groupBy("drug").agg(F.avg(c).alias("v")) for c in ("score", "case_count"))
    return T.paired_bootstrap(first, second, "drug", "v").select(*[r6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {B.PAIR_SQL}, g AS (SELECT condition, drug, score AS v, row_number() OVER (PARTITION BY condition ORDER BY drug) - 1 AS at_, count(*) OVER (PARTITION BY condition) AS n FROM sc),
    p AS (SELECT condition, b, CAST('0x' || substr(md5(concat_ws('|', condition, b, at_, 42)), 1, 8) AS BIGINT) % n AS k FROM g, range(200) AS r(b)), m AS (SELECT condition, b, avg(v) AS m FROM p JOIN g USING (condition) WHERE g.at_ = p.k GROUP BY 1, 2)
    SELECT condition, a.n, round(a.m, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT condition, count(*) AS n, avg(v) AS m FROM g GROUP BY 1) a JOIN (SELECT condition, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) USING (condition)""")
def outcome_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    out = T.bootstrap_by(B.scored(spark, d), "condition", "drug", "score")
    return out.select("condition", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


CLASS_SQL = f"""{B.PAIR_SQL}, cgp AS (SELECT s_suppkey AS drug, CASE WHEN s_suppkey % 5 = 0 THEN 'ing:' || s_suppkey ELSE 'leaf:k' || (s_nationkey % 11) END AS group_key FROM supplier),
    gs AS (SELECT group_key, count(*) AS n_pairs FROM sc JOIN cgp USING (drug) GROUP BY 1),
    qu AS (SELECT *, row_number() OVER (ORDER BY n_pairs DESC, md5(group_key || '42')) AS i, CAST((SELECT sum(n_pairs) FROM gs) AS DOUBLE) AS t FROM gs),
    wk(i, fold, a, b) AS (SELECT 0, '', 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i, fold, a + CASE WHEN fold = 'train2' THEN n_pairs ELSE 0 END, b + CASE WHEN fold = 'validate2' THEN n_pairs ELSE 0 END FROM (
        SELECT q.i, q.n_pairs, w.a, w.b, CASE WHEN (q.t * 0.625::DOUBLE - w.a) / (q.t * 0.625::DOUBLE) >= (q.t * 0.375::DOUBLE - w.b) / (q.t * 0.375::DOUBLE) THEN 'train2' ELSE 'validate2' END AS fold FROM (SELECT *, i + 1 AS nx FROM wk) w JOIN qu q ON q.i = w.nx))"""


@query(f"WITH RECURSIVE {CLASS_SQL} SELECT fold, count(*) AS n_pairs, count(DISTINCT drug) AS n_drugs, count(DISTINCT group_key) AS n_groups, round_even(avg(y), 4) AS positive_rate, round_even(count(*) / (SELECT count(*) FROM sc)::DOUBLE, 4) AS share FROM sc JOIN cgp USING (drug) JOIN (SELECT group_key, fold FROM wk JOIN qu USING (i)) USING (group_key) GROUP BY 1")
def class_resplit(spark: SparkSession, d: str) -> DataFrame:
    supplier = B.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "drug")
    leaf = F.concat(F.lit("k"), (F.col("s_nationkey") % 11).cast("string"))
    best = supplier.select("drug", F.when(F.col("drug") % 5 != 0, leaf).alias("leaf"), F.lit(True).alias("efficacy"), F.lit(1.0).alias("direct"))
    worse = supplier.where("drug % 5 <> 0").select("drug", F.lit("other").alias("leaf"), F.lit(False).alias("efficacy"), F.lit(1.0).alias("direct"))
    out = S.resplit(B.scored(spark, d), S.class_groups(best.unionByName(worse), supplier))
    groups = out.groupBy("fold").agg(F.count_distinct("group_key").alias("n_groups"))
    return S.fold_summary(out).join(groups, "fold").drop("n_conditions")


@query("""WITH b AS (SELECT vec_id AS id, list_filter(range(1, 65), lambda i: embedding[i] > 0.1) AS bits FROM embeddings), q AS (SELECT * FROM b WHERE id % 100 = 0),
    s AS (SELECT q.id, coalesce(max(len(list_intersect(q.bits, r.bits)) / (len(q.bits) + len(r.bits) - len(list_intersect(q.bits, r.bits)))::DOUBLE), 0) AS best FROM q, b r WHERE q.id <> r.id GROUP BY 1) SELECT id, best >= 0.4 AS in_domain FROM s""")
def domain_flags(spark: SparkSession, d: str) -> DataFrame:
    return N.in_domain(A.tanimoto_max(spark, d)).select("id", "in_domain")


PANEL = [f"n{i}" for i in range(5)]


@query("SELECT l_suppkey AS drug, " + ", ".join(f"max(l_quantity) FILTER (WHERE l_partkey % 7 = {i}) AS n{i}" for i in range(5)) + " FROM lineitem GROUP BY 1")
def off_target_panel(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("drug"), F.concat(F.lit("n"), (F.col("l_partkey") % 7).cast("string")).alias("off_target"), F.col("l_quantity").alias("affinity"))
    return N.wide_panel(rows, PANEL)


def designs(df: DataFrame, train: DataFrame, held: DataFrame, genes: DataFrame, condition_genes: DataFrame) -> DataFrame:
    """``design, macro_auc, n_groups`` of held-out pairs: features that copy labels, features that know none, and both.

    Label copies (the condition's rate and the neighbours' excess) come from
    ``train`` alone; a leak audit of the column names guards the others.
    """
    near = N.neighbour_counts(held, genes.withColumnRenamed("gene", "value"), train.select("drug").distinct(), train.where("y = 1"))
    copied = N.transported_rate(held.select("drug", "condition"), near, T.rates(train)).select("drug", "condition", F.coalesce("rate", F.lit(0.0)).alias("copying"))
    free = N.overlap(held.select("drug", "condition"), genes, condition_genes, "gene").select("drug", "condition", F.col("jaccard").alias("free"))
    if T.forbidden(free.columns, ("y", "p_c", "prr"), ("faers_", "n_flagged")):
        raise ValueError("a label-free design holds a label")
    rows = held.select("drug", "condition", "y").join(copied, ["drug", "condition"]).join(free, ["drug", "condition"])
    rows = rows.select("drug", "y", *[F.round(c, 9).alias(c) for c in ("copying", "free")], F.round(F.col("copying") + F.col("free"), 9).alias("union"))
    return E.scorer_table(rows, ["copying", "free", "union"], least=5).withColumnRenamed("scorer", "design")


DESIGN_SQL = f"""{B.PAIR_SQL}, {B.GENE_SQL}, {B.TRAIN_SQL},
    cn AS (SELECT DISTINCT condition FROM sc), co AS (SELECT condition, row_number() OVER (ORDER BY md5(condition || '42')) <= floor((SELECT count(*) FROM cn) * 0.2::DOUBLE) AS cold FROM cn),
    sp AS (SELECT 'standard' AS split, drug, condition, y, drug IN (SELECT drug FROM tr) AS train FROM sc UNION ALL SELECT 'cold', drug, condition, y, NOT cold FROM sc JOIN co USING (condition)),
    td AS (SELECT DISTINCT split, drug FROM sp WHERE train), nb AS (SELECT DISTINCT split, a.drug, b.drug AS neighbour FROM dg a JOIN dg b USING (gene) JOIN td ON td.drug = b.drug WHERE a.drug <> b.drug),
    kn AS (SELECT split, drug, count(*) AS n FROM nb GROUP BY ALL), pcr AS (SELECT split, condition, avg(y) AS p_c FROM sp WHERE train GROUP BY ALL),
    fl AS (SELECT nb.split, nb.drug, s.condition, count(*) AS n FROM nb JOIN sp s ON s.split = nb.split AND s.drug = nb.neighbour AND s.train AND s.y = 1 GROUP BY ALL),
    sh AS (SELECT drug, condition, count(*) AS n FROM dg JOIN cg USING (gene) GROUP BY 1, 2), dl AS (SELECT drug, count(*) AS n FROM dg GROUP BY 1), cr AS (SELECT condition, count(*) AS n FROM cg GROUP BY 1),
    xs AS (SELECT sp.split, sp.drug, y, coalesce((coalesce(fl.n, 0) + 10 * p_c) / (coalesce(kn.n, 0) + 10), 0) AS copying,
                  CASE WHEN coalesce(dl.n, 0) + coalesce(cr.n, 0) - coalesce(sh.n, 0) > 0 THEN coalesce(sh.n, 0) / (coalesce(dl.n, 0) + coalesce(cr.n, 0) - coalesce(sh.n, 0))::DOUBLE ELSE 0 END AS free
           FROM sp LEFT JOIN fl ON fl.split = sp.split AND fl.drug = sp.drug AND fl.condition = sp.condition LEFT JOIN kn ON kn.split = sp.split AND kn.drug = sp.drug LEFT JOIN pcr ON pcr.split = sp.split AND pcr.condition = sp.condition
           LEFT JOIN sh ON sh.drug = sp.drug AND sh.condition = sp.condition LEFT JOIN dl ON dl.drug = sp.drug LEFT JOIN cr ON cr.condition = sp.condition WHERE NOT train),
    lo AS (SELECT split, drug, y, 'copying' AS design, round(copying, 9) AS v FROM xs UNION ALL SELECT split, drug, y, 'free', round(free, 9) FROM xs UNION ALL SELECT split, drug, y, 'union', round(copying + free, 9) FROM xs),
    rk AS (SELECT *, rank() OVER (PARTITION BY split, design, drug ORDER BY v) + (count(*) OVER (PARTITION BY split, design, drug, v) - 1) / 2.0::DOUBLE AS r FROM lo),
    au AS (SELECT split, design, drug, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM rk GROUP BY ALL HAVING count(*) >= 5 AND sum(y) > 0 AND sum(y) < count(*))"""


@query(f"WITH {DESIGN_SQL} SELECT split, design, round(avg(auc), 6) AS macro_auc, count(*) AS n_groups FROM au GROUP BY 1, 2")
def split_designs(spark: SparkSession, d: str) -> DataFrame:
    """The three designs on the split by drugs and on the one by conditions; each takes its features from its own train pairs."""
    df = B.keep(B.scored(spark, d), "scored")
    genes, of_conditions = B.keep(B.drug_genes(spark, d), "genes"), B.keep(B.condition_genes(spark, d), "genes")
    cold = df.join(S.cold_conditions(df.select("condition")), "condition")
    parts = {
        "standard": (df.join(B.train_drugs(spark, d), "drug", "left_semi"), df.join(B.train_drugs(spark, d), "drug", "left_anti")),
        "cold": (cold.where("not cold").drop("cold"), cold.where("cold").drop("cold")),
    }
    tables = [designs(df, *pair, genes, of_conditions).withColumn("split", F.lit(name)) for name, pair in parts.items()]
    return tables[0].unionByName(tables[1]).select("split", "design", r6(F.col("macro_auc")).alias("macro_auc"), "n_groups")


@query(B.dictionary_sql("supplier", {"s_suppkey": "a key", "s_name": "a name", "s_nationkey": "a key", "s_acctbal": "balance"}))
def described_columns(spark: SparkSession, d: str) -> DataFrame:
    return T.dictionary(B.table(spark, d, "supplier"), "supplier", {"s_acctbal": "balance"}, [(".*key", "a key"), (".*name", "a name")])
