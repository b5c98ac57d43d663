"""Queries of notebooks, rankings and slopes over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as R
from ..operators import ontology as O
from ..operators import statistics as T
from ..sources.shared import keep
from ..streaming import notebook
from . import base as B
from .analysis import AUC_SQL
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


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as notebook entries: clicks register, purchases and views complete with metrics, others are notes; some break a rule or supersede the entry of 7 users before."""
    e = B.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "register").when(F.col("event_type").isin("purchase", "view"), "complete").otherwise("note")
    metric = F.when(F.col("event_id") % 3 == 0, "train_auc").otherwise("validate_auc")
    metrics = F.when(F.col("event_id") % 5 > 0, F.create_map(metric, F.col("value"), F.lit("n"), F.lit(1.0)))
    return e.select(
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("id"),
        kind.alias("event"),
        "ts",
        F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("agent"),
        F.lit(None).cast("string").alias("kind"),
        F.col("event_type").alias("title"),
        F.col("props").alias("body"),
        F.when(F.col("event_id") % 6 == 0, "mine").otherwise("other").alias("label"),
        metrics.alias("metrics"),
        F.when(F.col("event_id") % 7 == 0, " ").otherwise("found").alias("findings"),
        F.when((F.col("event_id") % 11 == 0) & (F.col("user_id") > 7), F.concat(F.lit("e"), (F.col("user_id") - 7).cast("string"))).alias("supersedes"),
        (F.col("event_id") % 13 == 0).alias("failed"),
        F.lit(False).alias("used_test_set"),
    )


ENTRY_SQL = """
    en AS (SELECT event_id, 'e' || user_id AS id, CASE WHEN event_type = 'click' THEN 'register' WHEN event_type IN ('purchase', 'view') THEN 'complete' ELSE 'note' END AS event, ts, 'a' || user_id % 4 AS agent,
                  CASE WHEN event_id % 6 = 0 THEN 'mine' ELSE 'other' END AS label, event_id % 5 > 0 AS measured, event_id % 5 > 0 AND event_id % 3 > 0 AS validated, value, event_id % 7 > 0 AS told,
                  CASE WHEN event_id % 11 = 0 AND user_id > 7 THEN 'e' || (user_id - 7) END AS supersedes, event_id % 13 = 0 AS failed FROM events),
    ck AS (SELECT *, CASE WHEN event = 'register' AND label <> 'other' THEN 'unknown label' WHEN event = 'complete' AND NOT measured THEN 'no metrics' WHEN event = 'complete' AND NOT told THEN 'no findings' END AS reason FROM en),
    ok AS (SELECT * FROM ck WHERE reason IS NULL)"""


@query(f"WITH {ENTRY_SQL} SELECT event, coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM ck GROUP BY 1, 2")
def notebook_checks(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each entry by the notebook's rules."""
    return entries(spark, d).groupBy("event", F.coalesce(notebook.reason(), F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def accepted(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where(notebook.reason().isNull())


@query(f"""WITH {ENTRY_SQL}, gone AS (SELECT DISTINCT supersedes AS id FROM ok WHERE supersedes IS NOT NULL AND supersedes <> id)
    SELECT id, event, count(*) AS n, max(ts) AS last FROM ok WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1, 2""")
def notebook_state(spark: SparkSession, d: str) -> DataFrame:
    """Entries that hold, by id and event, after what supersedes them."""
    return notebook.current(accepted(spark, d)).groupBy("id", "event").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query(f"""WITH {ENTRY_SQL}, bg AS (SELECT id, arg_max(agent, ts) AS agent FROM ok WHERE event = 'register' GROUP BY 1), dn AS (SELECT id, ts FROM ok WHERE event = 'complete' AND validated)
    SELECT agent, id, ts, row_number() OVER (PARTITION BY agent ORDER BY ts, id) AS evaluation FROM dn JOIN bg USING (id)""")
def validate_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Running number of the outcomes with a validation metric, by the agent that registered the experiment."""
    return notebook.evaluations(accepted(spark, d), "agent").select("agent", "id", "ts", "evaluation")


@query(f"""WITH {B.PAIR_SQL}, {AUC_SQL}, g AS (SELECT au.drug, auc, nation.n_regionkey * 1.0::DOUBLE + s_nationkey / 10.0::DOUBLE AS dist FROM au JOIN supplier ON au.drug = s_suppkey JOIN nation ON n_nationkey = s_nationkey),
    p AS (SELECT list_transform([{', '.join(str(w) for w in T.poisson_weights())}], lambda x: CAST(x AS BIGINT)) AS cuts),
    dr AS (SELECT r, len(list_filter(cuts, lambda c: c <= CAST('0x' || substr(md5(concat_ws('|', r, drug, 0)), 1, 8) AS BIGINT)))::DOUBLE AS w, dist AS x, auc AS y FROM g, p, range(200) AS b(r)),
    sm AS (SELECT r, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM dr GROUP BY 1),
    sl AS (SELECT (n * xy - x * y) / (n * xx - x * x) AS s FROM sm WHERE n * xx - x * x > 1e-12 * abs(n * xx))
    SELECT (SELECT count(*) FROM g) AS n, round((SELECT regr_slope(auc, dist) FROM g), 6) AS slope, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM sl""")
def slope_interval(spark: SparkSession, d: str) -> DataFrame:
    """Slope of a drug's AUC on a distance, with its interval over resampled drugs."""
    supplier, nation = B.table(spark, d, "supplier"), B.table(spark, d, "nation")
    far = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("drug"), (F.col("n_regionkey") + F.col("s_nationkey") / 10).alias("dist"))
    per = R.group_auc(B.scored(spark, d)).join(far, "drug")
    out = T.slope_interval(per, "drug", "dist", "auc", rounds=200)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("slope", "low", "high")])


LABEL_COLUMNS = {"signal": "y", "frequent": "CAST(case_count >= 25 AS INT)", "strong": "CAST(coalesce(prr >= 1.1, false) AS INT)"}
FEATURE_COLUMNS = {"score": "score", "cases": "CAST(case_count AS DOUBLE)", "length": "CAST(length(condition) AS DOUBLE)", "evenness": "CAST(drug % 5 AS DOUBLE)"}


@query(f"""WITH {B.PAIR_SQL}, lg AS ({' UNION ALL '.join(f"SELECT '{k}' AS label, '{f}' AS feature, {e} AS y, {v} AS v FROM sc" for k, e in LABEL_COLUMNS.items() for f, v in FEATURE_COLUMNS.items())}),
    rk AS (SELECT *, rank() OVER (PARTITION BY label, feature ORDER BY v) + (count(*) OVER (PARTITION BY label, feature, v) - 1) / 2.0::DOUBLE AS r FROM lg),
    a AS (SELECT label, feature, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM rk GROUP BY 1, 2 HAVING sum(y) > 0 AND sum(y) < count(*) AND count(DISTINCT v) > 1),
    f AS (SELECT label, feature, round(greatest(auc, 1 - auc), 6) AS auc FROM a), b AS (SELECT DISTINCT ON (label) label, feature AS best, auc FROM f ORDER BY label, auc DESC, feature),
    t AS (SELECT p.label, sum(sign(p.auc - q.auc) * sign(x.auc - z.auc)) / nullif(sqrt(sum(abs(sign(p.auc - q.auc))) * sum(abs(sign(x.auc - z.auc)))), 0) AS tau
          FROM f p JOIN f q ON p.label = q.label AND p.feature < q.feature JOIN f x ON x.label = 'signal' AND x.feature = p.feature JOIN f z ON z.label = 'signal' AND z.feature = q.feature GROUP BY 1)
    SELECT label, best, (SELECT count(DISTINCT best) FROM b) = 1 AS agree, round(tau, 6) AS tau FROM b LEFT JOIN t USING (label)""")
def ranking_stability(spark: SparkSession, d: str) -> DataFrame:
    """The feature that ranks best under each label, whether all labels agree on it, and tau of each label's ranking with the first's."""
    pairs = keep(B.scored(spark, d), "scored")
    parts = []
    for label, y in LABEL_COLUMNS.items():
        wide = pairs.select(F.expr(y).alias("y"), *[F.expr(v).alias(f) for f, v in FEATURE_COLUMNS.items()])
        parts.append(R.feature_screen(wide, list(FEATURE_COLUMNS)).select(F.lit(label).alias("label"), "feature", r6(F.col("folded_auc")).alias("value")))
    ranking = parts[0]
    for part in parts[1:]:
        ranking = ranking.unionByName(part)
    ranking = keep(ranking, "ranking")
    taus = None
    first = ranking.where("label = 'signal'").select("feature", F.col("value").alias("x"))
    for label in LABEL_COLUMNS:
        both = first.join(ranking.where(F.col("label") == label).select("feature", F.col("value").alias("z")), "feature", "full")
        one = R.kendall_tau_b(both.where("x is not null and z is not null"), "feature", "x", "z").select(F.lit(label).alias("label"), r6(F.col("tau")).alias("tau"))
        taus = one if taus is None else taus.unionByName(one)
    return R.best_features(ranking).join(taus, "label", "left")


@query(f"""WITH RECURSIVE {B.EDGE_SQL}, nm AS (SELECT 'N' || n_nationkey AS term, n_name AS name FROM nation UNION ALL SELECT 'C' || c_custkey, c_mktsegment FROM customer),
    ab AS (SELECT term, count(*) AS n_ancestors, CAST(max(distance) AS INT) AS depth FROM cs GROUP BY 1), sy AS (SELECT 'C' || o_custkey AS term, count(*) AS n_synonyms FROM orders GROUP BY 1)
    SELECT term, name, n_ancestors, depth, n_synonyms FROM nm LEFT JOIN ab USING (term) LEFT JOIN sy USING (term)""")
def term_context(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of customers and nations in their ontology; orders stand for synonyms."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation, customer, orders = (B.table(spark, d, t) for t in ("nation", "customer", "orders"))
    terms = nation.select(name("N", "n_nationkey").alias("term"), F.col("n_name").alias("name")).unionByName(customer.select(name("C", "c_custkey").alias("term"), F.col("c_mktsegment").alias("name")))
    closed = O.closure(B.ontology_edges(spark, d))
    itself = terms.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("distance"))
    named = closed.unionByName(itself).withColumn("ancestor_name", F.col("ancestor"))
    return O.term_context(terms, named, orders.select(name("C", "o_custkey").alias("term")))[0].select("term", "name", "n_ancestors", "depth", "n_synonyms")
