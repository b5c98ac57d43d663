"""Queries of labels, joins, aggregates, texts, sources and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import joins as J
from ..operators import mapping as M
from ..operators import statistics as T
from ..sources import catalog
from ..streaming import logs
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


@query(f"WITH {B.PAIR_SQL} SELECT drug, condition, case_count, round(prr, 6) AS prr, round(chi_square, 6) AS chi_square, CASE WHEN case_count > 1 THEN case_count >= 3 AND prr >= 1.3 AND chi_square >= 4 END AS faers_signal FROM sc")
def faers_signal_by_pair(spark: SparkSession, d: str) -> DataFrame:
    df = B.scored(spark, d)
    signal = L.signal(F.col("case_count") > 1, F.col("case_count"), F.col("prr"), F.col("chi_square"), B.MIN_PRR)
    return df.select("drug", "condition", "case_count", r6(F.col("prr")).alias("prr"), r6(F.col("chi_square")).alias("chi_square"), signal.alias("faers_signal"))


@query(f"WITH {B.PAIR_SQL} SELECT drug, condition, coalesce(case_count >= 3, false) AND coalesce(prr >= 2, false) AND coalesce(chi_square >= 4, false) AS y_faers_signal, causes > 0 OR (coalesce(case_count >= 3, false) AND coalesce(prr >= 2, false) AND coalesce(chi_square >= 4, false)) AS y_any_harm FROM pp")
def collapsed_labels(spark: SparkSession, d: str) -> DataFrame:
    df = L.sentence_sums(B.statistics(spark, d).withColumn("relations", B.relation_text()))
    signal = L.signal_or_false(F.col("case_count"), F.col("prr"), F.col("chi_square"))
    return df.select("drug", "condition", signal.alias("y_faers_signal"), (signal | (F.col("harm_sentences") > 0)).alias("y_any_harm"))


@query(f"WITH {B.PAIR_SQL}, {B.RELATION_SQL} SELECT drug, condition, relations, CAST(treats AS INT) AS n_treats, CAST(neg_treats AS INT) AS n_neg_treats, CAST(causes AS INT) AS n_causes, CAST(affects AS INT) AS n_affects FROM rl")
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    df = L.build_labels(B.pair_counts(spark, d).withColumn("relations", B.relation_text()))
    return df.select("drug", "condition", "relations", "n_treats", "n_neg_treats", "n_causes", "n_affects")


@query(f"""WITH {B.PAIR_SQL} SELECT drug, condition, CAST(CASE WHEN treats > 0 AND neg_treats = 0 THEN 1 WHEN neg_treats > 0 AND treats = 0 THEN 0 END AS TINYINT) AS efficacy_label, treats > 0 AND neg_treats > 0 AS efficacy_contradicted,
    CAST(CASE WHEN causes > 0 THEN 1 END AS TINYINT) AS harm_label, CAST(affects AS INT) AS nondirectional_asserted,
    (CASE WHEN treats > 0 AND neg_treats = 0 THEN 1 WHEN neg_treats > 0 AND treats = 0 THEN 0 END) = 1 AND (CASE WHEN causes > 0 THEN 1 END) = 1 AS treats_and_causes FROM pp""")
def directional_labels(spark: SparkSession, d: str) -> DataFrame:
    df = L.build_labels(B.pair_counts(spark, d).withColumn("relations", B.relation_text()))
    return df.select("drug", "condition", "efficacy_label", "efficacy_contradicted", "harm_label", "nondirectional_asserted", "treats_and_causes")


@query(f"WITH {B.PAIR_SQL} SELECT drug, condition, CAST(causes AS INT) AS harm_sentences, CAST(treats AS INT) AS benefit_sentences, CAST(neg_treats AS INT) AS negated_sentences FROM pp")
def sentence_sums(spark: SparkSession, d: str) -> DataFrame:
    df = L.sentence_sums(B.pair_counts(spark, d).withColumn("relations", B.relation_text()))
    return df.select("drug", "condition", "harm_sentences", "benefit_sentences", "negated_sentences")


@query(f"WITH {B.PAIR_SQL} SELECT condition, count(*) AS condition_degree, round(ln(1 + count(*)), 6) AS log_condition_degree FROM pc GROUP BY 1")
def pair_degrees(spark: SparkSession, d: str) -> DataFrame:
    df = L.degrees(B.pair_counts(spark, d), "condition", "condition_degree")
    return df.withColumn("log_condition_degree", r6(F.col("log_condition_degree")))


@query(f"WITH {B.PAIR_SQL} SELECT drug, condition, count(*) OVER (PARTITION BY drug) AS drug_degree, count(*) OVER (PARTITION BY condition) AS condition_degree FROM pc")
def nuisance_join(spark: SparkSession, d: str) -> DataFrame:
    pairs = B.keep(B.pair_counts(spark, d)).select("drug", "condition")
    out = J.lookup(J.lookup(pairs, L.degrees(pairs, "drug", "drug_degree"), "drug"), L.degrees(pairs, "condition", "condition_degree"), "condition")
    return out.select("drug", "condition", "drug_degree", "condition_degree")


@query("SELECT * FROM (SELECT p_brand AS condition, p_partkey AS term, p_type AS tier, min(p_type) OVER (PARTITION BY p_brand) AS best FROM part) WHERE tier = best")
def best_tier_matches(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part").select(F.col("p_brand").alias("condition"), F.col("p_partkey").alias("term"), F.col("p_type").alias("tier"))
    return J.best_tier(part, "condition", "tier").withColumn("best", F.col("tier"))


@query("SELECT p_brand AS condition, count(*) FILTER (WHERE p_size > 25) AS n_large, max(p_retailprice) FILTER (WHERE p_type = 'PROMO') AS max_promo, count(DISTINCT p_name) FILTER (WHERE p_type = 'SMALL') AS n_small_names, round(avg(CAST(p_size > 10 AS INT)), 6) AS share_over_10, bool_or(p_size = 50) AS any_50 FROM part GROUP BY 1")
def filtered_aggs(spark: SparkSession, d: str) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size")
    return (
        B.table(spark, d, "part")
        .groupBy(F.col("p_brand").alias("condition"))
        .agg(
            B.n_if(size > 25).alias("n_large"),
            F.max(F.when(kind == "PROMO", F.col("p_retailprice"))).alias("max_promo"),
            F.count_distinct(F.when(kind == "SMALL", F.col("p_name"))).alias("n_small_names"),
            r6(F.avg((size > 10).cast("double"))).alias("share_over_10"),
            F.bool_or(size == 50).alias("any_50"),
        )
    )


@query(f"""WITH {B.PAIR_SQL}, {B.GENE_SQL}, cur AS (SELECT DISTINCT p_brand AS condition, p_name AS gene, true AS c FROM part WHERE p_size < 8), ev AS (SELECT condition, gene, score, true AS s FROM cg WHERE score > 2)
    SELECT condition, gene, coalesce(c, false) AS from_curated, coalesce(s, false) AS from_scored, score AS max_score, score AS genetic_score, CAST(coalesce(s, false) AS BIGINT) AS n_types FROM cur FULL JOIN ev USING (condition, gene)""")
def full_outer_evidence(spark: SparkSession, d: str) -> DataFrame:
    curated = B.table(spark, d, "part").where("p_size < 8").select(F.col("p_brand").alias("condition"), F.col("p_name").alias("gene"))
    evidence = B.condition_genes(spark, d).where("score > 2").select("condition", "gene", F.lit("genetic_association").alias("data_type"), F.col("score").alias("max_score"))
    return M.condition_genes(curated, evidence)


@query(f"""WITH {B.PAIR_SQL}, {B.GENE_SQL} SELECT c.condition, CAST(count(DISTINCT gene) AS BIGINT) AS n_genes, count(DISTINCT gene) FILTER (WHERE cur) AS n_curated, count(DISTINCT gene) FILTER (WHERE ev) AS n_scored, max(CASE WHEN ev THEN score END) AS max_genetic_score
    FROM (SELECT condition, gene, score, score > 2 AS ev, (condition, gene) IN (SELECT (p_brand, p_name) FROM part WHERE p_size < 8) AS cur FROM cg) c WHERE cur OR ev GROUP BY 1""")
def condition_scalars(spark: SparkSession, d: str) -> DataFrame:
    return M.condition_scalars(full_outer_evidence(spark, d))


@query("SELECT p_brand AS condition, string_agg(DISTINCT p_type, '+' ORDER BY p_type) AS types FROM part GROUP BY 1")
def distinct_join_sorted(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "part").groupBy(F.col("p_brand").alias("condition")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), "+").alias("types"))


@query(f"WITH {B.PAIR_SQL}, {B.GENE_SQL} SELECT condition, gene, score FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY score DESC, gene) AS n FROM cg) WHERE n <= 5")
def top_m_per_group(spark: SparkSession, d: str) -> DataFrame:
    return J.top_per_group(B.condition_genes(spark, d), "condition", 5, F.desc("score"), F.col("gene"))


@query(f"WITH {B.PAIR_SQL}, {B.GENE_SQL} SELECT drug, condition, count(*) AS n_genes, sum(score) AS weight FROM dg JOIN cg USING (gene) GROUP BY 1, 2")
def gene_links(spark: SparkSession, d: str) -> DataFrame:
    return J.gene_links(B.drug_genes(spark, d), B.condition_genes(spark, d).withColumnRenamed("score", "weight"))


@query("SELECT p_type, count(*) AS n, round_even(count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE), 4) AS share FROM part GROUP BY 1")
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    return J.share_of(B.table(spark, d, "part"), "p_type")


@query("SELECT condition, p_type FROM (SELECT p_brand AS condition, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS n FROM part GROUP BY 1, 2) WHERE n = 1")
def dominant_class(spark: SparkSession, d: str) -> DataFrame:
    return J.most_common(B.table(spark, d, "part").withColumnRenamed("p_brand", "condition"), "condition", "p_type")


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS kind FROM part), t AS (SELECT kind FROM p WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 2)
    SELECT count(*) AS n, count(*) FILTER (WHERE kind IS NULL) AS n_null, count(*) FILTER (WHERE kind IN (SELECT kind FROM t)) AS n_top, count(*) FILTER (WHERE kind IS NOT NULL AND kind NOT IN (SELECT kind FROM t)) AS n_other FROM p""")
def one_hot_top_k(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part").select(F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("kind"))
    hot = J.one_hot(part, "kind", 2, "k")
    top = [F.col(f"`{c}`") for c in hot.columns if c not in ("kind", "k_other")]
    return hot.agg(F.count(F.lit(1)).alias("n"), B.n_if(F.col("kind").isNull()).alias("n_null"), sum(map(F.sum, top)).cast("long").alias("n_top"), F.sum("k_other").cast("long").alias("n_other"))


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("SELECT p_name AS gene, " + ", ".join(f"CAST(bool_or(p_type = '{k}') AS BIGINT) AS {k}" for k in KINDS) + " FROM part GROUP BY 1")
def pivot_groups(spark: SparkSession, d: str) -> DataFrame:
    return J.pivot_flags(B.table(spark, d, "part").withColumnRenamed("p_name", "gene"), "gene", "p_type", KINDS)


@query(f"""WITH {B.PAIR_SQL}, x AS (SELECT CAST(drug % 5 AS VARCHAR) AS drug_class, CASE WHEN case_count < 20 THEN NULL ELSE substr(condition, 1, 7) END AS condition_class, y FROM sc)
    SELECT 'drug_class' AS variable, drug_class AS level, count(*) AS n, round(avg(y), 6) AS prevalence FROM x GROUP BY 2 UNION ALL SELECT 'condition_class', condition_class, count(*), round(avg(y), 6) FROM x GROUP BY 2""")
def subgroup_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    df = B.scored(spark, d).select((F.col("drug") % 5).cast("string").alias("drug_class"), F.when(F.col("case_count") >= 20, F.substring("condition", 1, 7)).alias("condition_class"), "y")
    return J.subgroups(df, ["drug_class", "condition_class"], F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("prevalence"))


@query("SELECT s_suppkey AS drug, coalesce(v, (SELECT median(v) FROM x), 0.0) AS v FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS v FROM supplier)".replace("FROM x", "FROM (SELECT CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS v FROM supplier) x"))
def median_imputation(spark: SparkSession, d: str) -> DataFrame:
    df = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("v"))
    return J.impute(df, "v")


@query(f"WITH {B.PAIR_SQL} SELECT CASE WHEN case_count < 6 THEN '3-5' WHEN case_count < 21 THEN '6-20' ELSE '21+' END AS stratum, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM sc WHERE case_count >= 3 GROUP BY 1")
def case_strata(spark: SparkSession, d: str) -> DataFrame:
    stratum = F.when(F.col("case_count") < 6, "3-5").when(F.col("case_count") < 21, "6-20").otherwise("21+")
    return B.scored(spark, d).where("case_count >= 3").groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '\(.*?\)', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS normalised FROM documents""")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", X.normalise(F.col("text")).alias("normalised"))


@query("SELECT p_partkey AS term, array_to_string(list_sort(list_filter(string_split(p_name || ' of the ' || lower(p_type), ' '), lambda w: w NOT IN ('of', 'the', 'a', 'an', 'in', 'on', 'with', 'and', 'to', 'by') AND w <> '')), ' ') AS token_key FROM part")
def token_key(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" of the "), F.lower("p_type"))
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("term"), X.token_key(name).alias("token_key"))


@query(r"SELECT n_nationkey, regexp_replace(n_name, '^([A-Za-z][A-Za-z0-9.]*)_([0-9]+)$', '\1:\2') AS colon, n_name AS back FROM nation")
def id_forms(spark: SparkSession, d: str) -> DataFrame:
    colon = X.colon_id(F.col("n_name"))
    return B.table(spark, d, "nation").select("n_nationkey", colon.alias("colon"), X.underscore_id(colon).alias("back"))


@query("SELECT p_partkey AS id, CASE p_type WHEN 'SMALL' THEN 'SNOMED' WHEN 'LARGE' THEN 'Orphanet' ELSE 'ICD10' END AS source, CAST(p_size AS VARCHAR) AS code FROM part WHERE p_type IN ('SMALL', 'LARGE', 'PROMO')")
def xref_triples(spark: SparkSession, d: str) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    raw = F.when(kind == "SMALL", F.concat(F.lit("snomedct_us: "), size)).when(kind == "LARGE", F.concat(F.lit("ORPHA:"), size)).when(kind == "PROMO", F.concat(F.lit("icd-10:"), size)).otherwise(F.concat(F.lit("FOO:"), size))
    part = B.table(spark, d, "part").withColumn("_x", F.explode(F.array(raw, F.lit("MESH:"))))
    return part.select(F.col("p_partkey").alias("id"), X.xref(F.col("_x")).alias("x")).where("x is not null").select("id", "x.source", "x.code")


@query("""WITH m AS (SELECT p_partkey AS condition, p_name AS name FROM part), l AS (SELECT DISTINCT p_name AS label, 'T' || p_name AS term FROM part WHERE p_size > 30)
    SELECT condition, term, coalesce(tier, '0_unmatched') AS tier FROM m LEFT JOIN (
        SELECT condition, term, min(tier) AS tier FROM (
            SELECT condition, 'X' || (condition % 10) AS term, '1_sctid_xref' AS tier FROM m WHERE condition % 10 < 3
            UNION ALL SELECT condition, term, '2_label_exact' FROM m JOIN l ON name = label WHERE condition % 2 = 0
            UNION ALL SELECT condition, term, '2b_synonym_exact' FROM m JOIN l ON name = label WHERE condition % 2 = 1 AND condition % 6 = 1
            UNION ALL SELECT condition, term, '3_token_exact' FROM m JOIN l ON name = label) GROUP BY 1, 2) USING (condition)""")
def tiered_mapping(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part").withColumn("c", F.col("p_partkey"))
    turned = F.concat(F.substring_index("p_name", " ", -1), F.lit(" of the (x) "), F.substring_index("p_name", " ", 1))
    conditions = part.select(F.col("c").alias("condition"), F.when(F.col("c") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" (finding)"))).otherwise(turned).alias("name"), (F.col("c") % 10).cast("string").alias("code"))
    synonyms = part.where("c % 6 = 1").select(F.col("c").alias("condition"), F.initcap("p_name").alias("synonym"))
    codes = spark.range(3).select(F.col("id").cast("string").alias("code"), F.concat(F.lit("X"), F.col("id").cast("string")).alias("term"))
    labels = part.where("p_size > 30").select(F.col("p_name").alias("label"), F.concat(F.lit("T"), "p_name").alias("term"))
    return M.tiered_mapping(conditions, synonyms, codes, labels)


@query("SELECT p_brand AS condition, p_name AS gene, p_type AS data_type, max(p_retailprice) AS max_score, CAST(coalesce(sum(CASE WHEN p_size < 40 THEN p_size END), 0) AS BIGINT) AS n_evidence FROM part WHERE p_type <> 'PROMO' AND p_brand <> 'Brand#1' GROUP BY 1, 2, 3")
def gene_evidence(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part")
    kind = F.when(F.col("p_type") == "PROMO", "known_drug").otherwise(F.col("p_type"))
    found = part.select(F.concat(F.lit("T"), "p_brand").alias("term"), F.col("p_name").alias("gene"), kind.alias("data_type"), F.col("p_retailprice").alias("score"), F.when(F.col("p_size") < 40, F.col("p_size")).alias("n_evidence"))
    mapping = part.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("condition"), F.concat(F.lit("T"), "p_brand").alias("term")).distinct()
    return M.gene_evidence(found, mapping)


@query(f"""WITH {B.PAIR_SQL}, r AS (SELECT drug, condition, CASE WHEN CAST(q AS INT) % 3 = 0 THEN 'mesh' ELSE 'ontology' END AS route, f, q FROM li)
    SELECT drug, condition, max(CAST(q AS INT) % 5) AS max_phase, count(DISTINCT route) > 0 AND max(CAST(q AS INT) % 5) >= 4 AS is_approved, CAST(max(CAST(q AS INT)) AS INT) AS n_refs, string_agg(DISTINCT route, '+' ORDER BY route) AS matched_via, min(CAST(q AS INT) * 10) AS n_descendants
    FROM r WHERE CAST(q AS INT) * 10 <= 480 GROUP BY 1, 2""")
def pair_indications(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ontology import not_too_general

    q = F.col("l_quantity").cast("int")
    rows = B.lines(spark, d).select("drug", "condition", (q % 5).alias("max_phase"), q.alias("n_refs"), (q * 10).alias("n_descendants"))
    both = rows.withColumn("route", F.when(F.col("n_refs") % 3 == 0, "mesh").otherwise("ontology"))
    return J.pair_indications(not_too_general(both, 480))


@query(f"""WITH {B.PAIR_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY coalesce(prr, 0) DESC, condition) AS n FROM sc)
    SELECT drug, count(*) AS n_pairs, count(DISTINCT condition) AS n_conditions, count(*) FILTER (WHERE y = 1) AS n_signals, string_agg(condition, '|' ORDER BY n) FILTER (WHERE n <= 3) AS top_conditions FROM x GROUP BY 1""")
def drug_evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    df = B.scored(spark, d)
    top = J.top_per_group(df.withColumn("p", F.coalesce("prr", F.lit(0.0))), "drug", 3, F.desc("p"), F.col("condition"))
    names = top.groupBy("drug").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("o"), "condition"))), lambda x: x["condition"]), "|").alias("top_conditions"))
    return df.groupBy("drug").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("condition").alias("n_conditions"), B.n_if(F.col("y") == 1).alias("n_signals")).join(names, "drug")


@query("SELECT c_nationkey AS item, round_even(avg(c_acctbal / 10000), 3) AS treats, round_even(coalesce(stddev_samp(c_acctbal / 10000), 0), 3) AS treats_spread, round_even(avg((c_custkey % 7) / 10.0::DOUBLE), 3) AS causes, round_even(coalesce(stddev_samp((c_custkey % 7) / 10.0::DOUBLE), 0), 3) AS causes_spread, count(*) AS n_votes, CASE WHEN round_even(avg(c_acctbal / 10000), 3) >= round_even(avg((c_custkey % 7) / 10.0::DOUBLE), 3) + 0.1::DOUBLE THEN 'treats' WHEN round_even(avg((c_custkey % 7) / 10.0::DOUBLE), 3) >= round_even(avg(c_acctbal / 10000), 3) + 0.1::DOUBLE THEN 'causes' ELSE 'unclear' END AS direction FROM customer GROUP BY 1")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    votes = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("item"), (F.col("c_acctbal") / 10000).alias("treats"), ((F.col("c_custkey") % 7) / F.lit(10.0)).alias("causes"))
    return J.consensus(votes, "item", "treats", "causes")


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders) WHERE row_index BETWEEN 120 AND 169")
def paged_read(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.numbered(B.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return catalog.page(rows, 120, 50).select("row_index", F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority")


@query("SELECT CAST(n_nationkey AS BIGINT) AS row_index, CASE WHEN n_nationkey % 5 = 0 THEN 'edited' ELSE n_name END AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation UNION ALL SELECT CAST(25 AS BIGINT), 'new', ''")
def commit_edits(spark: SparkSession, d: str) -> DataFrame:
    nation = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("row_index"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    edits = nation.where("row_index % 5 = 0").select("row_index", F.explode(F.array(F.struct(F.lit("n_name").alias("column"), F.lit("old").alias("value"), F.lit(1).alias("seq")), F.struct(F.lit("n_name").alias("column"), F.lit("edited").alias("value"), F.lit(2).alias("seq")), F.struct(F.lit("none").alias("column"), F.lit("x").alias("value"), F.lit(3).alias("seq")))).alias("e")).select("row_index", "e.*")
    adds = spark.createDataFrame([("new",)], "n_name string")
    return catalog.edited(nation, edits, adds)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_log_state(spark: SparkSession, d: str) -> DataFrame:
    events = B.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return logs.latest(events, "user_id", "ts", "event_id").drop("ts")


@query("SELECT CAST(row_number() OVER (ORDER BY value DESC, CAST(event_id AS VARCHAR)) AS INT) AS rank, CAST(event_id AS VARCHAR) AS id, event_type AS label, value AS metric FROM events WHERE event_type = 'click' AND event_id % 3 <> 0 AND event_id % 11 <> 0")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    events = B.table(spark, d, "events").withColumn("id", F.col("event_id").cast("string"))
    begun = events.select("id", F.lit("register").alias("event"), F.col("event_type").alias("label"), F.lit(None).cast("double").alias("metric"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("supersedes"))
    done = events.where("event_id % 3 <> 0").select("id", F.lit("complete").alias("event"), F.col("event_type").alias("label"), F.col("value").alias("metric"), (F.col("event_id") % 11 == 0).alias("failed"), F.lit(None).cast("string").alias("supersedes"))
    return logs.leaderboard(logs.current(begun.unionByName(done)), "click")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 2 = 1 AS odd FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json(X.json_in_text(F.concat(F.lit("```json "), "props", F.lit(" ```"))), "k int")["k"]
    return B.table(spark, d, "events").select("event_id", k.alias("k"), X.truth((k % 2).cast("string")).alias("odd"))


@query(B.dictionary_sql("customer", {"c_custkey": None, "c_name": None, "c_nationkey": None, "c_acctbal": None, "c_mktsegment": None}))
def data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return T.dictionary(B.table(spark, d, "customer"), "customer")
