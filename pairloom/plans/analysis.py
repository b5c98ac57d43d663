"""Queries of metrics, ontologies, networks, splits and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import metrics as R
from ..operators import network as N
from ..operators import ontology as O
from ..operators import splits as S
from ..operators import statistics as T
from ..sources.catalog import tiles
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


AUC_SQL = """
    rk AS (SELECT *, rank() OVER (PARTITION BY drug ORDER BY score) + (count(*) OVER (PARTITION BY drug, score) - 1) / 2.0::DOUBLE AS r FROM sc),
    au AS (SELECT drug, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc
           FROM rk GROUP BY 1 HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*))"""


@query(f"WITH {B.PAIR_SQL}, {AUC_SQL} SELECT drug, n, positives, round(auc, 6) AS auc FROM au")
def group_auc(spark: SparkSession, d: str) -> DataFrame:
    return R.group_auc(B.scored(spark, d)).withColumn("auc", r6(F.col("auc")))


@query(f"WITH {B.PAIR_SQL}, {AUC_SQL} SELECT round(avg(auc), 6) AS macro_auc, count(*) AS n_groups FROM au")
def macro_auc(spark: SparkSession, d: str) -> DataFrame:
    return R.macro_auc(B.scored(spark, d)).withColumn("macro_auc", r6(F.col("macro_auc")))


@query(f"""WITH {B.PAIR_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY score) + (count(*) OVER (PARTITION BY condition, score) - 1) / 2.0::DOUBLE AS r FROM sc)
    SELECT condition, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS auc FROM rk GROUP BY 1 HAVING count(*) >= 5 AND sum(y) > 0 AND sum(y) < count(*)""")
def outcome_auc(spark: SparkSession, d: str) -> DataFrame:
    outcomes = B.table(spark, d, "part").select(F.col("p_brand").alias("condition")).distinct()
    return R.restricted_auc(B.scored(spark, d), outcomes, min_pairs=5).withColumn("auc", r6(F.col("auc")))


@query(f"""WITH {B.PAIR_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY score DESC, condition) AS n FROM sc)
    SELECT drug, round(sum(CASE WHEN n <= 10 THEN y ELSE 0 END) / least(10, count(*))::DOUBLE, 6) AS precision, round(CASE WHEN sum(y) > 0 THEN sum(CASE WHEN n <= 15 THEN y ELSE 0 END) / sum(y)::DOUBLE END, 6) AS recall FROM rk GROUP BY 1""")
def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    out = R.at_k(B.scored(spark, d), recall_k=15)
    return out.select("drug", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query(f"""WITH {B.PAIR_SQL}, st AS (SELECT condition, score, sum(y) AS hits, count(*) AS n FROM sc GROUP BY 1, 2),
    cu AS (SELECT *, sum(hits) OVER w AS tp, sum(n) OVER w AS seen FROM st WINDOW w AS (PARTITION BY condition ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT condition, round(sum(hits * tp / seen::DOUBLE) / sum(hits), 6) AS average_precision FROM cu GROUP BY 1 HAVING sum(hits) > 0""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    out = R.average_precision(B.scored(spark, d), "condition")
    return out.withColumn("average_precision", r6(F.col("average_precision")))


@query(f"""WITH {B.PAIR_SQL}, rk AS (SELECT drug, rank() OVER (PARTITION BY drug ORDER BY score) + (count(*) OVER (PARTITION BY drug, score) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY drug ORDER BY case_count) + (count(*) OVER (PARTITION BY drug, case_count) - 1) / 2.0::DOUBLE AS z FROM sc)
    SELECT drug, count(*) AS n, round(corr(x, z), 6) AS rho FROM rk GROUP BY 1""")
def spearman_within_group(spark: SparkSession, d: str) -> DataFrame:
    return R.spearman(B.scored(spark, d), "drug", "score", "case_count").withColumn("rho", r6(F.col("rho")))


@query(f"WITH {B.PAIR_SQL} SELECT round(corr(score, case_count), 6) AS pearson, round(1 - sum((case_count - 3 * score) * (case_count - 3 * score)) / (sum(case_count * case_count) - sum(case_count) * sum(case_count) / count(*)::DOUBLE), 6) AS r_squared, round(sqrt(avg((case_count - 3 * score) * (case_count - 3 * score))), 6) AS rmse FROM sc")
def regression_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scored(spark, d).select(F.col("case_count").cast("double").alias("t"), (3 * F.col("score")).alias("g"))
    return R.regression_errors(rows, "t", "g").select(*[r6(F.col(c)).alias(c) for c in ("pearson", "r_squared", "rmse")])


@query(f"""WITH {B.PAIR_SQL}, k AS (SELECT drug, sum(score) AS x, sum(case_count) AS z FROM sc GROUP BY 1)
    SELECT round(sum(sign(a.x - b.x) * sign(a.z - b.z)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.z - b.z)))), 6) AS tau FROM k a JOIN k b ON a.drug < b.drug""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    ranks = B.scored(spark, d).groupBy("drug").agg(F.sum("score").alias("x"), F.sum("case_count").alias("z"))
    return R.kendall_tau_b(ranks, "drug", "x", "z").select(r6(F.col("tau")).alias("tau"))


@query(f"WITH {B.PAIR_SQL}, p AS (SELECT score / case_count AS p, y FROM sc) SELECT CAST(least(floor(p * 20), 19) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM p GROUP BY 1")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scored(spark, d).select((F.col("score") / F.col("case_count")).alias("p"), "y")
    return R.calibration(rows, "p", "y").select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("mean_y")).alias("mean_y"))


@query(f"""WITH {B.PAIR_SQL}, p AS (SELECT score AS p, y FROM sc), e AS (SELECT unnest(quantile_cont(p, [{', '.join(str(i / 10) for i in range(1, 10))}])) AS q FROM p),
    b AS (SELECT p, y, (SELECT count(*) FROM e WHERE p.p > e.q) AS bin FROM p) SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM b GROUP BY 1""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scored(spark, d).select(F.col("score").alias("p"), "y")
    return R.quantile_calibration(rows, "p", "y").select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("mean_y")).alias("mean_y"))


@query(f"WITH {B.PAIR_SQL} SELECT condition, round(regr_slope(score, case_count), 6) AS slope FROM sc GROUP BY 1")
def ols_slope(spark: SparkSession, d: str) -> DataFrame:
    return R.slope_by_group(B.scored(spark, d), "condition", "case_count", "score").withColumn("slope", r6(F.col("slope")))


@query(f"""WITH {B.PAIR_SQL}, lg AS (SELECT 'score' AS feature, score AS value, y FROM sc UNION ALL SELECT 'case_count', case_count, y FROM sc UNION ALL SELECT 'size', length(condition), y FROM sc),
    rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM lg),
    a AS (SELECT feature, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM rk GROUP BY 1)
    SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS folded_auc FROM a""")
def leak_screen_auc(spark: SparkSession, d: str) -> DataFrame:
    wide = B.scored(spark, d).select("y", "score", F.col("case_count").cast("double").alias("case_count"), F.length("condition").cast("double").alias("size"), F.lit(1.0).alias("constant"))
    out = R.feature_screen(wide, ["score", "case_count", "size", "constant"])
    return out.select("feature", r6(F.col("auc")).alias("auc"), r6(F.col("folded_auc")).alias("folded_auc"))


@query(f"WITH RECURSIVE {B.EDGE_SQL} SELECT term, ancestor, CAST(distance AS INT) AS distance FROM cs")
def closure(spark: SparkSession, d: str) -> DataFrame:
    return O.closure(B.ontology_edges(spark, d))


@query(f"WITH RECURSIVE {B.EDGE_SQL}, tm AS (SELECT child AS term FROM ed UNION SELECT parent FROM ed UNION SELECT 'LOST') SELECT tm.term, CASE WHEN tm.term = 'ROOT' THEN 0 ELSE cs.distance END AS depth FROM tm LEFT JOIN cs ON tm.term = cs.term AND cs.ancestor = 'ROOT'")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    edges = B.ontology_edges(spark, d)
    terms = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct().union(spark.createDataFrame([("LOST",)], "term string"))
    return O.depth(O.closure(edges), terms, "ROOT")


@query(f"WITH RECURSIVE {B.EDGE_SQL} SELECT ancestor AS term, count(*) AS n_descendants FROM cs GROUP BY 1")
def descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.descendants(O.closure(B.ontology_edges(spark, d))).groupBy("term").agg(F.count(F.lit(1)).alias("n_descendants"))


@query(f"WITH RECURSIVE {B.EDGE_SQL}, {B.ANNOTATION_SQL} SELECT term, gene FROM an WHERE NOT EXISTS (SELECT 1 FROM ed JOIN an c ON ed.child = c.term WHERE ed.parent = an.term AND c.gene = an.gene)")
def specific_genes(spark: SparkSession, d: str) -> DataFrame:
    return O.specific(B.annotations(spark, d), B.ontology_edges(spark, d))


@query(f"WITH RECURSIVE {B.EDGE_SQL}, {B.ANNOTATION_SQL}, ct AS (SELECT term, count(DISTINCT gene) AS n FROM an GROUP BY 1) SELECT term, n, round(greatest(0, -ln(n / (SELECT n FROM ct WHERE term = 'ROOT')::DOUBLE)), 6) AS information_content FROM ct")
def information_content(spark: SparkSession, d: str) -> DataFrame:
    out = O.information_content(B.annotations(spark, d), "ROOT")
    return out.withColumn("information_content", r6(F.col("information_content")))


NEIGHBOUR_SQL = f"""{B.PAIR_SQL}, {B.GENE_SQL}, {B.TRAIN_SQL},
    te AS (SELECT drug, gene AS value FROM dg),
    nb AS (SELECT DISTINCT a.drug, b.drug AS neighbour FROM te a JOIN te b ON a.value = b.value AND a.drug <> b.drug WHERE b.drug IN (SELECT drug FROM tr)),
    pcr AS (SELECT condition, avg(y) AS p_c FROM sc WHERE drug IN (SELECT drug FROM tr) GROUP BY 1),
    nt AS (SELECT sc.drug, sc.condition, coalesce(k.n, 0) AS n_neighbours, coalesce(h.n, 0) AS n_flagged, p_c
           FROM sc LEFT JOIN (SELECT drug, count(*) AS n FROM nb GROUP BY 1) k USING (drug)
           LEFT JOIN (SELECT nb.drug, s.condition, count(*) AS n FROM nb JOIN sc s ON s.drug = nb.neighbour AND s.y = 1 GROUP BY 1, 2) h ON h.drug = sc.drug AND h.condition = sc.condition
           LEFT JOIN pcr ON pcr.condition = sc.condition)"""


def transported(spark: SparkSession, d: str) -> DataFrame:
    df, train = B.keep(B.scored(spark, d), "scored"), B.train_drugs(spark, d)
    known = df.join(train, "drug", "left_semi")
    near = N.neighbour_counts(df, B.drug_genes(spark, d).withColumnRenamed("gene", "value"), train, known.where("y = 1"))
    return N.transported_rate(df.select("drug", "condition"), near, T.rates(known))


@query(f"WITH {NEIGHBOUR_SQL} SELECT drug, condition, n_neighbours, n_flagged, round((n_flagged + 10 * p_c) / (n_neighbours + 10), 6) AS rate, round((n_flagged + 10 * p_c) / (n_neighbours + 10) - p_c, 6) AS excess FROM nt")
def neighbour_shrunk_rate(spark: SparkSession, d: str) -> DataFrame:
    return transported(spark, d).select("drug", "condition", "n_neighbours", "n_flagged", r6(F.col("rate")).alias("rate"), r6(F.col("excess")).alias("excess"))


@query(f"WITH {NEIGHBOUR_SQL} SELECT round(avg(CAST(n_neighbours >= 1 AS INT)), 6) AS share_1, round(avg(CAST(n_neighbours >= 3 AS INT)), 6) AS share_3, (SELECT round(avg(CAST(n = 0 AS INT)), 6) FROM (SELECT drug, max(n_neighbours) AS n FROM nt GROUP BY 1)) AS drugs_without FROM nt")
def neighbour_coverage(spark: SparkSession, d: str) -> DataFrame:
    return N.neighbour_coverage(B.keep(transported(spark, d))).select(*[r6(F.col(c)).alias(c) for c in ("share_1", "share_3", "drugs_without")])


@query(f"""WITH {B.PAIR_SQL}, {B.GENE_SQL}, sh AS (SELECT drug, condition, count(*) AS n, sum(score) AS s, max(score) AS m FROM dg JOIN cg USING (gene) GROUP BY 1, 2),
    l AS (SELECT drug, count(*) AS n FROM dg GROUP BY 1), r AS (SELECT condition, count(*) AS n FROM cg GROUP BY 1)
    SELECT drug, condition, coalesce(sh.n, 0) AS n_shared, coalesce(sh.s, 0) AS sum_weight, coalesce(sh.m, 0) AS max_weight, round(CASE WHEN coalesce(l.n, 0) + coalesce(r.n, 0) - coalesce(sh.n, 0) > 0 THEN coalesce(sh.n, 0) / (coalesce(l.n, 0) + coalesce(r.n, 0) - coalesce(sh.n, 0))::DOUBLE ELSE 0 END, 6) AS jaccard
    FROM pc LEFT JOIN sh USING (drug, condition) LEFT JOIN l USING (drug) LEFT JOIN r USING (condition)""")
def gene_overlap_jaccard(spark: SparkSession, d: str) -> DataFrame:
    out = N.overlap(B.pair_counts(spark, d).select("drug", "condition"), B.drug_genes(spark, d), B.condition_genes(spark, d), "gene", "score")
    return out.select("drug", "condition", "n_shared", F.col("sum_weight").cast("double").alias("sum_weight"), F.col("max_weight").cast("double").alias("max_weight"), r6(F.col("jaccard")).alias("jaccard"))


@query(f"WITH {B.PAIR_SQL}, {B.GENE_SQL} SELECT gene, count(DISTINCT condition) AS df, round(ln((SELECT count(DISTINCT condition) FROM cg) / count(DISTINCT condition)::DOUBLE), 6) AS idf FROM cg GROUP BY 1")
def gene_idf(spark: SparkSession, d: str) -> DataFrame:
    return N.gene_idf(B.condition_genes(spark, d)).withColumn("idf", r6(F.col("idf")))


@query(f"""WITH {B.PAIR_SQL}, {B.GENE_SQL}, top AS (SELECT condition, gene FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY score DESC, gene) AS n FROM cg) WHERE n <= 50),
    dp AS (SELECT DISTINCT drug, pathway FROM dg JOIN gp USING (gene)), cp AS (SELECT DISTINCT condition, pathway FROM top JOIN gp USING (gene)),
    sh AS (SELECT drug, condition, count(*) AS n FROM dp JOIN cp USING (pathway) GROUP BY 1, 2), l AS (SELECT drug, count(*) AS n FROM dp GROUP BY 1), r AS (SELECT condition, count(*) AS n FROM cp GROUP BY 1)
    SELECT drug, condition, coalesce(sh.n, 0) AS n_shared, round(CASE WHEN coalesce(l.n, 0) + coalesce(r.n, 0) - coalesce(sh.n, 0) > 0 THEN coalesce(sh.n, 0) / (coalesce(l.n, 0) + coalesce(r.n, 0) - coalesce(sh.n, 0))::DOUBLE ELSE 0 END, 6) AS jaccard
    FROM pc LEFT JOIN sh USING (drug, condition) LEFT JOIN l USING (drug) LEFT JOIN r USING (condition)""")
def pathway_overlap(spark: SparkSession, d: str) -> DataFrame:
    out = N.pathway_overlap(B.pair_counts(spark, d).select("drug", "condition"), B.drug_genes(spark, d), B.condition_genes(spark, d), B.gene_pathways(spark, d))
    return out.select("drug", "condition", "n_shared", r6(F.col("jaccard")).alias("jaccard"))


@query(f"""WITH {B.PAIR_SQL}, {B.GENE_SQL}, {B.TRAIN_SQL}, lv AS (SELECT s_suppkey AS drug, s_nationkey AS nation, CAST(floor(s_acctbal / 20) AS BIGINT) AS band FROM supplier)
    SELECT drug, CASE WHEN drug IN (SELECT drug FROM lv WHERE band IN (SELECT band FROM lv JOIN tr USING (drug))) THEN 'D0' WHEN drug IN (SELECT drug FROM lv WHERE nation IN (SELECT nation FROM lv JOIN tr USING (drug) WHERE nation < 12)) THEN 'D1' WHEN drug % 2 = 0 THEN 'D2' ELSE 'D3' END AS rung FROM lv""")
def distance_rungs(spark: SparkSession, d: str) -> DataFrame:
    supplier = B.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "drug")
    levels = {"band": supplier.select("drug", F.floor(F.col("s_acctbal") / 20).alias("value")), "nation": supplier.select("drug", F.when(F.col("s_nationkey") < 12, F.col("s_nationkey")).alias("value"))}
    return N.rungs(supplier, B.train_drugs(spark, d), levels, supplier.where("drug % 2 = 0"))


@query("""WITH s AS (SELECT p_type AS set_id, p_partkey AS condition FROM part), m AS (SELECT p_partkey AS condition, p_name || p_brand AS ontology_id FROM part),
    t AS (SELECT DISTINCT set_id, ontology_id FROM s JOIN m USING (condition)) SELECT set_id, condition FROM s UNION SELECT set_id, condition FROM t JOIN m USING (ontology_id)""")
def syndrome_widening(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part")
    members = part.select(F.col("p_type").alias("set_id"), F.col("p_partkey").alias("condition"))
    return N.widened(members, part.select(F.col("p_partkey").alias("condition"), F.concat("p_name", "p_brand").alias("ontology_id")))


@query(f"""WITH {B.PAIR_SQL}, {B.GENE_SQL}, pn AS (SELECT drug, gene AS off_target, max(q) AS affinity FROM li GROUP BY 1, 2), sy AS (SELECT DISTINCT p_brand AS condition, p_name AS off_target FROM part),
    b AS (SELECT drug, condition, max(affinity) AS affinity FROM pn JOIN sy USING (off_target) GROUP BY 1, 2) SELECT drug, condition, affinity, affinity IS NOT NULL AS has_affinity FROM pc LEFT JOIN b USING (drug, condition)""")
def syndrome_affinity(spark: SparkSession, d: str) -> DataFrame:
    panel = B.lines(spark, d).groupBy("drug", F.col("gene").alias("off_target")).agg(F.max("l_quantity").alias("affinity"))
    sets = B.table(spark, d, "part").select(F.col("p_brand").alias("condition"), F.col("p_name").alias("off_target")).distinct()
    return N.affinity(B.pair_counts(spark, d).select("drug", "condition"), panel, sets)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'd' || s_suppkey AS a, 'g' || CAST(floor(s_acctbal / 50) AS BIGINT) AS b FROM supplier UNION SELECT DISTINCT 'd' || s_suppkey, 'n' || (s_suppkey // 7) FROM supplier WHERE s_suppkey % 3 = 0),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, seen) AS (SELECT a, a FROM u UNION SELECT w.node, u.b FROM w JOIN u ON w.seen = u.a) SELECT node, min(seen) AS component FROM w GROUP BY 1""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    supplier, name = B.table(spark, d, "supplier"), lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    key = F.col("s_suppkey")
    genes = supplier.select(name("d", key).alias("a"), name("g", F.floor(F.col("s_acctbal") / 50)).alias("b"))
    more = supplier.where("s_suppkey % 3 = 0").select(name("d", key).alias("a"), name("n", F.floor(key / 7)).alias("b"))
    return N.connected(genes.unionByName(more), "a", "b")


@query("""WITH b AS (SELECT vec_id AS id, list_filter(range(1, 65), lambda i: embedding[i] > 0.1) AS bits FROM embeddings), q AS (SELECT * FROM b WHERE id % 100 = 0), r AS (SELECT * FROM b)
    SELECT q.id, round(coalesce(max(len(list_intersect(q.bits, r.bits)) / (len(q.bits) + len(r.bits) - len(list_intersect(q.bits, r.bits)))::DOUBLE), 0), 6) AS best FROM q, r WHERE q.id <> r.id GROUP BY 1""")
def tanimoto_max(spark: SparkSession, d: str) -> DataFrame:
    found = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0.1, i)), lambda i: i.isNotNull())
    rows = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), found.alias("bits"))
    return N.tanimoto(rows.where("id % 100 = 0"), rows).withColumn("best", r6(F.col("best")))


def grouped(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    supplier = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("group_key"))
    return pairs.join(supplier, "drug")


def folds_of(rows: DataFrame) -> DataFrame:
    return S.greedy_folds(rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_pairs")))


FOLD_SQL = f"""{B.PAIR_SQL}, gs AS (SELECT 'n' || s_nationkey AS group_key, count(*) AS n_pairs FROM pc JOIN supplier ON drug = s_suppkey GROUP BY 1),
    qu AS (SELECT *, row_number() OVER (ORDER BY n_pairs DESC, md5(group_key || '42')) AS i, CAST((SELECT sum(n_pairs) FROM gs) AS DOUBLE) AS t FROM gs),
    wk(i, fold, a, b, c) AS (SELECT 0, '', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i, fold, a + CASE WHEN fold = 'train' THEN n_pairs ELSE 0 END, b + CASE WHEN fold = 'validate' THEN n_pairs ELSE 0 END, c + CASE WHEN fold = 'test' THEN n_pairs ELSE 0 END FROM (
        SELECT q.i, q.n_pairs, w.a, w.b, w.c, CASE WHEN x >= y AND x >= z THEN 'train' WHEN y >= z THEN 'validate' ELSE 'test' END AS fold
        FROM (SELECT *, i + 1 AS nx FROM wk) w JOIN qu q ON q.i = w.nx, LATERAL (SELECT (0.5::DOUBLE * q.t - w.a) / (0.5::DOUBLE * q.t) AS x, (0.3::DOUBLE * q.t - w.b) / (0.3::DOUBLE * q.t) AS y, (0.2::DOUBLE * q.t - w.c) / (0.2::DOUBLE * q.t) AS z))),
    fo AS (SELECT group_key, fold FROM wk JOIN qu USING (i))"""


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT group_key, fold FROM fo")
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    return folds_of(grouped(spark, d, B.pair_counts(spark, d)))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped(spark, d, B.keep(B.scored(spark, d), "scored"))
    return rows.join(folds_of(rows), "group_key")


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT fold, count(*) AS n_pairs, count(DISTINCT drug) AS n_drugs, count(DISTINCT condition) AS n_conditions, round_even(avg(y), 4) AS positive_rate, round_even(count(*) / (SELECT count(*) FROM sc)::DOUBLE, 4) AS share FROM sc JOIN supplier ON drug = s_suppkey JOIN fo ON group_key = 'n' || s_nationkey GROUP BY 1")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.fold_summary(assigned(spark, d))


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT drug, count(DISTINCT fold) AS n_folds FROM sc JOIN supplier ON drug = s_suppkey JOIN fo ON group_key = 'n' || s_nationkey GROUP BY 1 HAVING count(DISTINCT fold) > 1")
def fold_leaks(spark: SparkSession, d: str) -> DataFrame:
    return S.leaks(assigned(spark, d), "drug")


@query(f"""WITH {B.PAIR_SQL} SELECT s_suppkey AS drug, coalesce('gene:' || g, 'ing:' || s_suppkey) AS group_key FROM supplier LEFT JOIN (
    SELECT drug, first(gene ORDER BY e DESC, q DESC, gene) AS g FROM (SELECT drug, CASE WHEN drug % 9 <> 0 THEN gene END AS gene, CAST(f = 'R' AS INT) AS e, q FROM li) WHERE gene IS NOT NULL GROUP BY 1) ON drug = s_suppkey""")
def primary_gene_groups(spark: SparkSession, d: str) -> DataFrame:
    targets = B.lines(spark, d).select("drug", F.when(F.col("drug") % 9 != 0, F.col("gene")).alias("gene"), (F.col("l_returnflag") == "R").cast("int").alias("efficacy"), F.col("l_quantity").alias("direct"))
    return S.primary_gene(targets, B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug")))


@query("WITH c AS (SELECT DISTINCT p_brand AS condition FROM part) SELECT condition, row_number() OVER (ORDER BY md5(condition || '42')) <= floor((SELECT count(*) FROM c) * 0.2::DOUBLE) AS cold FROM c")
def cold_conditions(spark: SparkSession, d: str) -> DataFrame:
    return S.cold_conditions(B.table(spark, d, "part").select(F.col("p_brand").alias("condition")))


@query("SELECT DISTINCT 'n' || s_nationkey AS group_key, CAST(CAST('0x' || substr(md5('n' || s_nationkey), 1, 8) AS BIGINT) % 3 AS INT) AS fold FROM supplier")
def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    return S.group_folds(B.table(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("group_key")))


@query(f"WITH {B.PAIR_SQL}, {B.TRAIN_SQL}, pr AS (SELECT condition, avg(y) AS p FROM sc WHERE drug IN (SELECT drug FROM tr) AND condition <> 'Brand#1' GROUP BY 1) SELECT drug, condition, round(coalesce(p, (SELECT avg(p) FROM pr)), 6) AS score FROM sc LEFT JOIN pr USING (condition) WHERE drug NOT IN (SELECT drug FROM tr)")
def floor_scores(spark: SparkSession, d: str) -> DataFrame:
    df, train = B.scored(spark, d), B.train_drugs(spark, d)
    held = df.join(train, "drug", "left_anti").select("drug", "condition")
    return T.floor_scores(df.join(train, "drug", "left_semi").where("condition <> 'Brand#1'"), held).withColumn("score", r6(F.col("score")))


@query(f"WITH {B.PAIR_SQL} SELECT drug, condition, round(case_count - avg(case_count) OVER (PARTITION BY condition), 6) AS residual FROM sc")
def one_way_demean(spark: SparkSession, d: str) -> DataFrame:
    return T.demean(B.scored(spark, d), "condition", "case_count").select("drug", "condition", r6(F.col("residual")).alias("residual"))


@query(f"WITH {B.PAIR_SQL}, x AS (SELECT case_count AS v, case_count - avg(case_count) OVER (PARTITION BY condition) AS r FROM sc) SELECT round(1 - var_pop(r) / var_pop(v), 6) AS between, round(var_pop(r) / var_pop(v), 6) AS inside FROM x".replace("AS between", 'AS "between"'))
def variance_shares(spark: SparkSession, d: str) -> DataFrame:
    out = T.variance_shares(T.demean(B.scored(spark, d), "condition", "case_count"), "condition", "case_count")
    return out.select(r6(F.col("between")).alias("between"), r6(F.col("inside")).alias("inside"))


#: Alternating means of the SQL; more change nothing in the places that are compared.
SQL_ROUNDS = 12
DEMEAN_SQL = ", ".join(f"r{k + 1} AS (SELECT drug, condition, v - avg(v) OVER (PARTITION BY {('drug', 'condition')[k % 2]}) AS v FROM r{k})" for k in range(2 * SQL_ROUNDS))


@query(f"WITH {B.PAIR_SQL}, r0 AS (SELECT drug, condition, CAST(case_count AS DOUBLE) AS v FROM sc), {DEMEAN_SQL} SELECT drug, condition, round(v, 5) + 0 AS residual FROM r{2 * SQL_ROUNDS}")
def two_way_demean(spark: SparkSession, d: str) -> DataFrame:
    out = T.two_way_demean(B.scored(spark, d), "drug", "condition", "case_count", rounds=200, tolerance=1e-9)
    return out.select("drug", "condition", (F.round("residual", 5) + 0).alias("residual"))


@query(f"""WITH {B.PAIR_SQL}, v AS (SELECT drug, avg(score) AS v FROM sc GROUP BY 1), w AS (SELECT b, {B.weight_sql(42, 'b', 'drug')} AS w, v FROM v, range(1000) AS r(b)), m AS (SELECT b, sum(w * v) / sum(w) AS m FROM w GROUP BY 1 HAVING sum(w) > 0)
    SELECT round((SELECT avg(v) FROM v), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    per = B.scored(spark, d).groupBy("drug").agg(F.avg("score").alias("v"))
    return T.bootstrap(per, "drug", "v", rounds=1000).select(*[r6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {B.PAIR_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY drug) AS i, row_number() OVER (PARTITION BY condition ORDER BY md5(drug || '42'), drug) AS j FROM sc)
    SELECT a.drug, a.condition, a.case_count, b.case_count AS placebo FROM a JOIN a b ON a.condition = b.condition AND a.i = b.j""")
def within_group_permutation(spark: SparkSession, d: str) -> DataFrame:
    return T.permuted(B.scored(spark, d), "condition", "drug", "case_count").select("drug", "condition", "case_count", "placebo")


@query(f"WITH {B.PAIR_SQL}, {B.GENE_SQL} SELECT 'drug' AS side, CAST(drug AS VARCHAR) AS node, count(*) AS degree FROM dg GROUP BY 2 UNION ALL SELECT 'gene', gene, count(*) FROM dg GROUP BY 2")
def edge_swap(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of both sides of the rewired edges, which equal those before; a test counts the edges that are new."""
    new = B.keep(T.swap_edges(B.drug_genes(spark, d), "drug", "gene"))
    sides = [new.groupBy(F.lit(c).alias("side"), F.col(c).cast("string").alias("node")).agg(F.count(F.lit(1)).alias("degree")) for c in ("drug", "gene")]
    return sides[0].unionByName(sides[1])


@query(f"""WITH {B.PAIR_SQL}, x AS (SELECT ntile(4) OVER (ORDER BY drug, condition) AS design, score FROM sc), m AS (SELECT design, avg(score) AS metric FROM x GROUP BY 1)
    SELECT CAST(design AS INT) AS design, round(metric, 6) AS metric, round(metric - lag(metric) OVER (ORDER BY design), 6) AS increment, abs(metric - lag(metric) OVER (ORDER BY design)) < 0.01 AS is_noise FROM m""")
def ablation_increments(spark: SparkSession, d: str) -> DataFrame:
    designs = tiles(B.scored(spark, d), ["drug", "condition"], 4, "design").select("design", "score")
    out = T.increments(designs.groupBy("design").agg(F.avg("score").alias("metric")), "design", "metric")
    return out.select("design", r6(F.col("metric")).alias("metric"), r6(F.col("increment")).alias("increment"), "is_noise")


@query("SELECT n_nationkey AS term, n_regionkey AS n_descendants FROM nation WHERE n_regionkey <= 3")
def term_generality(spark: SparkSession, d: str) -> DataFrame:
    nation = B.table(spark, d, "nation").withColumn("n", F.col("n_regionkey"))
    first = nation.select(F.col("n_nationkey").alias("term"), F.col("n").alias("n_descendants"), F.lit(0).alias("priority"))
    both = first.unionByName(first.withColumns({"n_descendants": F.col("n_descendants") + 9, "priority": F.lit(1)}))
    return O.not_too_general(O.generality(both), 3)


@query(f"WITH {B.PAIR_SQL} SELECT drug, avg(case_count) AS mean_cases, CAST(sum(y) > 0 AS BOOLEAN) AS curated FROM sc GROUP BY 1".replace("avg(case_count)", "round(avg(case_count), 6)"))
def curated_drugs(spark: SparkSession, d: str) -> DataFrame:
    return B.scored(spark, d).groupBy("drug").agg(r6(F.avg("case_count")).alias("mean_cases"), (F.sum("y") > 0).alias("curated"))
