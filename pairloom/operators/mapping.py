"""Tiered mapping of conditions to ontology terms, and the evidence that comes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, token_key

# Tiers in order of trust; they sort by name.
CODE, LABEL, SYNONYM, TOKENS, NONE = "1_sctid_xref", "2_label_exact", "2b_synonym_exact", "3_token_exact", "0_unmatched"
#: Evidence types that hold what is to be predicted.
LEAKY = ("known_drug", "clinical")


def tiered_mapping(conditions: DataFrame, synonyms: DataFrame, codes: DataFrame, labels: DataFrame) -> DataFrame:
    """``condition, term, tier``: each term by the best tier that finds it; a row without term for what nothing finds.

    ``conditions`` condition, name, code; ``synonyms`` condition, synonym;
    ``codes`` code, term; ``labels`` label, term. Names that normalise to
    nothing match nothing, and a synonym like the name is not tried again.
    """
    named = conditions.withColumn("_n", normalise(F.col("name")))
    terms = labels.select("term", normalise(F.col("label")).alias("_n")).where("_n <> ''").distinct()
    by_tokens = terms.select("term", token_key(F.col("_n")).alias("_k")).where("_k <> ''").distinct()
    other = synonyms.select("condition", normalise(F.col("synonym")).alias("_s")).join(named.select("condition", "_n"), "condition").where("_s <> _n and _s <> ''").select("condition", F.col("_s").alias("_n")).distinct()
    found = [
        (CODE, named.select("condition", "code").join(codes, "code")),
        (LABEL, named.select("condition", "_n").join(terms, "_n")),
        (SYNONYM, other.join(terms, "_n")),
        (TOKENS, named.select("condition", token_key(F.col("_n")).alias("_k")).join(by_tokens, "_k")),
    ]
    rows = None
    for tier, matches in found:
        one = matches.select("condition", "term", F.lit(tier).alias("tier"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("condition", "term").agg(F.min("tier").alias("tier"))
    return conditions.select("condition").join(best, "condition", "left").select("condition", "term", F.coalesce("tier", F.lit(NONE)).alias("tier"))


def gene_evidence(associations: DataFrame, mapping: DataFrame) -> DataFrame:
    """``condition, gene, data_type, max_score, n_evidence``; leaky types are left out, an unknown count is 0."""
    rows = associations.where(~F.col("data_type").isin(*LEAKY)).join(mapping.select("condition", "term"), "term")
    return rows.groupBy("condition", "gene", "data_type").agg(F.max("score").alias("max_score"), F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("n_evidence"))


def condition_genes(curated: DataFrame, evidence: DataFrame) -> DataFrame:
    """``condition, gene`` from either source with flags, the strongest score and that of genetic evidence."""
    strong = evidence.groupBy("condition", "gene").agg(
        F.max("max_score").alias("max_score"), F.max(F.when(F.col("data_type") == "genetic_association", F.col("max_score"))).alias("genetic_score"), F.count_distinct("data_type").alias("n_types")
    )
    left = curated.select("condition", "gene").distinct().withColumn("from_curated", F.lit(True))
    both = left.join(strong.withColumn("from_scored", F.lit(True)), ["condition", "gene"], "full")
    return both.withColumns({"from_curated": F.coalesce("from_curated", F.lit(False)), "from_scored": F.coalesce("from_scored", F.lit(False)), "n_types": F.coalesce("n_types", F.lit(0))})


def condition_scalars(genes: DataFrame) -> DataFrame:
    return genes.groupBy("condition").agg(
        F.count_distinct("gene").alias("n_genes"),
        F.count_distinct(F.when(F.col("from_curated"), F.col("gene"))).alias("n_curated"),
        F.count_distinct(F.when(F.col("from_scored"), F.col("gene"))).alias("n_scored"),
        F.max("genetic_score").alias("max_genetic_score"),
    )


def to_symbols(evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """Evidence by gene symbol: several ids of one symbol become one row before any later join."""
    return evidence.join(symbols, "gene").groupBy("condition", "symbol").agg(F.max("max_score").alias("max_score"), F.count_distinct("gene").alias("n_ids"))
