"""The driver's star schema in the roles of evidence tables, in Spark and in SQL.

A drug is a supplier, a condition a brand, a pair's evidence the lines of the
supplier's parts of the brand; genes are part names, the ontology is that of
customers, nations, regions and market segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.statistics import poisson_weights
from ..sources.shared import keep

MIN_PRR = 1.3  # the tables are near uniform, so that 2 leaves hardly a signal


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dictionary_sql(name: str, described: dict[str, str | None]) -> str:
    """The SQL of a table's dictionary: types and shares are read from the table."""
    kind = "CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END"
    parts = []
    for c, text in described.items():
        told = f", '{text}' AS description" if text else ""
        parts.append(f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", {kind.format(c=c)} AS type, round_even(count({c}) / count(*)::DOUBLE, 4) AS share_present{told} FROM {name}")
    return " UNION ALL ".join(parts)


def weight_sql(seed: int, *cols: str) -> str:
    """The SQL of a resample's weight."""
    cuts = ", ".join(map(str, poisson_weights()))
    return f"len(list_filter([{cuts}]::BIGINT[], lambda c: c <= CAST('0x' || substr(md5(concat_ws('|', {', '.join(cols)}, {seed})), 1, 8) AS BIGINT)))"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def lines(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("drug"), "l_quantity", "l_returnflag", "l_linestatus")
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("condition"), F.col("p_name").alias("gene"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"))


def n_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """drug, condition, case_count, a, score, and counts that stand for relations."""
    flag, status, q = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    return (
        lines(spark, d)
        .groupBy("drug", "condition")
        .agg(
            F.count(F.lit(1)).alias("case_count"),
            n_if(flag == "R").alias("a"),
            n_if(flag == "A").cast("double").alias("score"),
            n_if((flag == "N") & (q > 44)).alias("treats"),
            n_if((flag == "A") & (q < 4)).alias("neg_treats"),
            n_if((flag == "R") & (q > 46)).alias("causes"),
            n_if((status == "O") & (q < 3)).alias("affects"),
        )
    )


PAIR_SQL = """
    li AS (SELECT l_orderkey, l_suppkey AS drug, p_brand AS condition, p_name AS gene, l_quantity AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
    pc AS (SELECT drug, condition, count(*) AS case_count, count(*) FILTER (WHERE f = 'R') AS a, CAST(count(*) FILTER (WHERE f = 'A') AS DOUBLE) AS score,
                  count(*) FILTER (WHERE f = 'N' AND q > 44) AS treats, count(*) FILTER (WHERE f = 'A' AND q < 4) AS neg_treats,
                  count(*) FILTER (WHERE f = 'R' AND q > 46) AS causes, count(*) FILTER (WHERE s = 'O' AND q < 3) AS affects
           FROM li GROUP BY 1, 2),
    pm AS (SELECT *, CAST(sum(a) OVER (PARTITION BY drug) AS DOUBLE) AS nd, CAST(sum(a) OVER (PARTITION BY condition) AS DOUBLE) AS nc, CAST(sum(a) OVER () AS DOUBLE) AS n FROM pc),
    pp AS (SELECT *, CASE WHEN (nc - a) * nd > 0 THEN a * (n - nd) / ((nc - a) * nd) END AS prr,
                  CASE WHEN nd * (n - nd) * nc * (n - nc) > 0 THEN n * (a * (n - nd - nc + a) - (nd - a) * (nc - a)) * (a * (n - nd - nc + a) - (nd - a) * (nc - a)) / (nd * (n - nd) * nc * (n - nc)) END AS chi_square FROM pm),
    sc AS (SELECT drug, condition, case_count, score, prr, chi_square, CAST(coalesce(prr >= 1.3 AND case_count >= 3, false) AS INT) AS y FROM pp)"""


def statistics(spark: SparkSession, d: str) -> DataFrame:
    """The pair table is kept: its margins and totals are small sums over it, not three more scans of the lines."""
    return L.disproportionality(keep(pair_counts(spark, d)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """drug, condition, case_count, score, prr, chi_square, y."""
    y = F.coalesce((F.col("prr") >= MIN_PRR) & (F.col("case_count") >= 3), F.lit(False)).cast("int").alias("y")
    return statistics(spark, d).select("drug", "condition", "case_count", "score", "prr", "chi_square", y)


def relation_text() -> Column:
    """The counts as ``REL=n`` joined by ``;``."""
    names = {"TREATS": "treats", "NEG_TREATS": "neg_treats", "CAUSES": "causes", "AFFECTS": "affects"}
    return F.concat_ws(";", *[F.when(F.col(c) > 0, F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in names.items()])


RELATION_SQL = "rl AS (SELECT *, concat_ws(';', CASE WHEN treats > 0 THEN 'TREATS=' || treats END, CASE WHEN neg_treats > 0 THEN 'NEG_TREATS=' || neg_treats END, CASE WHEN causes > 0 THEN 'CAUSES=' || causes END, CASE WHEN affects > 0 THEN 'AFFECTS=' || affects END) AS relations FROM pp)"


def drug_genes(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where("l_quantity >= 49 and l_returnflag = 'R'").select("drug", "gene").distinct()


def condition_genes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").groupBy(F.col("p_brand").alias("condition"), F.col("p_name").alias("gene"))
    return part.agg(F.count(F.lit(1)).cast("double").alias("score"))


def gene_pathways(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size > 45").select(F.col("p_name").alias("gene"), F.col("p_type").alias("pathway")).distinct()


GENE_SQL = """
    dg AS (SELECT DISTINCT drug, gene FROM li WHERE q >= 49 AND f = 'R'),
    cg AS (SELECT p_brand AS condition, p_name AS gene, CAST(count(*) AS DOUBLE) AS score FROM part GROUP BY 1, 2),
    gp AS (SELECT DISTINCT p_name AS gene, p_type AS pathway FROM part WHERE p_size > 45)"""


def train_drugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("drug"))


TRAIN_SQL = "tr AS (SELECT s_suppkey AS drug FROM supplier WHERE s_suppkey % 3 <> 0)"


def ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers below nations and segments, nations below regions, both below a root."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    parts = [
        customer.select(name("C", "c_custkey").alias("child"), name("N", "c_nationkey").alias("parent")),
        customer.select(name("C", "c_custkey").alias("child"), name("M", "c_mktsegment").alias("parent")),
        nation.select(name("N", "n_nationkey").alias("child"), name("R", "n_regionkey").alias("parent")),
        region.select(name("R", "r_regionkey").alias("child"), F.lit("ROOT").alias("parent")),
        customer.select(name("M", "c_mktsegment").alias("child"), F.lit("ROOT").alias("parent")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGE_SQL = """
    ed AS (SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION SELECT 'C' || c_custkey, 'M' || c_mktsegment FROM customer
           UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || r_regionkey, 'ROOT' FROM region UNION SELECT 'M' || c_mktsegment, 'ROOT' FROM customer),
    cl(term, ancestor, distance) AS (SELECT child, parent, 1 FROM ed UNION SELECT cl.term, ed.parent, cl.distance + 1 FROM cl JOIN ed ON cl.ancestor = ed.child),
    cs AS (SELECT term, ancestor, min(distance) AS distance FROM cl GROUP BY 1, 2)"""


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """term, gene: order priorities of customers and of all that is above them."""
    from ..operators.ontology import closure

    own = table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("term"), F.concat("o_orderpriority", F.lit(":"), F.month("o_orderdate").cast("string")).alias("gene")).distinct()
    above = closure(ontology_edges(spark, d)).join(own, "term").select(F.col("ancestor").alias("term"), "gene")
    return own.unionByName(above).distinct()


ANNOTATION_SQL = "ow AS (SELECT DISTINCT 'C' || o_custkey AS term, o_orderpriority || ':' || month(o_orderdate) AS gene FROM orders), an AS (SELECT term, gene FROM ow UNION SELECT cs.ancestor, gene FROM cs JOIN ow USING (term))"
