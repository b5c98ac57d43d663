"""Joins of evidence tables: lookups, best tiers, pairs that share genes, surviving null keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: list[str] | str) -> DataFrame:
    """Left join to a table with one row for each key, so that no row is multiplied."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(table.dropDuplicates(keys), keys, "left")


def only(df: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def outer_flags(left: DataFrame, right: DataFrame, on: list[str], left_flag: str, right_flag: str) -> DataFrame:
    """Full outer join with one set of keys and a flag for each side."""
    joined = left.withColumn(left_flag, F.lit(True)).join(right.withColumn(right_flag, F.lit(True)), on, "full")
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in (left_flag, right_flag)})


def best_tier(matches: DataFrame, key: str, tier: str) -> DataFrame:
    """All rows of a key at its lowest tier."""
    return matches.withColumn("_best", F.min(tier).over(Window.partitionBy(key))).where(F.col(tier) == F.col("_best")).drop("_best")


def first_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_row = 1").drop("_row")


def first_value(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The first value of each key that is not null, in the given order."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def gene_links(targets: DataFrame, genes: DataFrame, drug: str = "drug", condition: str = "condition", gene: str = "gene", weight: str = "weight") -> DataFrame:
    """``drug, condition, n_genes, weight``: pairs that share a gene, which each pair counts once."""
    edges = targets.select(drug, gene).where(F.col(gene).isNotNull()).distinct()
    return edges.join(genes.where(F.col(gene).isNotNull()), gene).groupBy(drug, condition).agg(F.count(F.lit(1)).alias("n_genes"), F.sum(weight).alias("weight"))


def top_per_group(df: DataFrame, group: str, m: int, *order: Column) -> DataFrame:
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_row") <= m).drop("_row")


def share_of(df: DataFrame, key: str, places: int = 4) -> DataFrame:
    """``key, n, share`` of all rows; null is a value."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    every = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.bround(F.col("n") / every, places))


def most_common(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equal ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def subgroups(df: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    """One table of group-bys on each column: ``variable, level`` and the aggregates; null is a level."""
    long = df.unpivot([c for c in df.columns if c not in columns], columns, "variable", "level")
    return long.groupBy("variable", "level").agg(*aggregates)


def one_hot(df: DataFrame, column: str, cap: int, prefix: str) -> DataFrame:
    """0/1 columns of the ``cap`` most frequent values and one for the others; null is 0 in all."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(cap)
    top = [r[0] for r in counts.collect()]
    hot = {f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in top}
    other = F.when(F.col(column).isNull() | F.col(column).isin(top), 0).otherwise(1)
    return df.withColumns(hot | {f"{prefix}_other": other})


def pivot_flags(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """A 0/1 matrix of which values a key has."""
    wide = df.groupBy(key).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.select(key, *[F.least(F.coalesce(F.col(f"`{v}`"), F.lit(0)), F.lit(1)).alias(v) for v in values])


def impute(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Missing values take the group's median, then that of all rows, then 0."""
    every = df.agg(F.percentile(column, 0.5)).scalar()
    if group is None:
        return df.withColumn(column, F.coalesce(column, every, F.lit(0.0)))
    middle = df.groupBy(group).agg(F.percentile(column, 0.5).alias("_median"))
    return df.join(middle, group, "left").withColumn(column, F.coalesce(column, "_median", every, F.lit(0.0))).drop("_median")


def consensus(votes: DataFrame, item: str, treats: str, causes: str) -> DataFrame:
    """Mean and sample deviation of the votes (0 below two) and the direction that leads by 0.1 or more."""
    score = lambda c: F.bround(F.avg(c), 3)
    spread = lambda c: F.bround(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 3)
    per = votes.groupBy(item).agg(score(treats).alias("treats"), spread(treats).alias("treats_spread"), score(causes).alias("causes"), spread(causes).alias("causes_spread"), F.count(F.lit(1)).alias("n_votes"))
    return per.withColumn("direction", F.when(F.col("treats") >= F.col("causes") + 0.1, "treats").when(F.col("causes") >= F.col("treats") + 0.1, "causes").otherwise("unclear"))


def pair_indications(routes: DataFrame) -> DataFrame:
    """Pairs from several routes: highest phase, references, the routes joined by +, the least general term, and whether approved."""
    per = routes.groupBy("drug", "condition").agg(
        F.max("max_phase").alias("max_phase"),
        F.max("n_refs").alias("n_refs"),
        F.array_join(F.sort_array(F.collect_set("route")), "+").alias("matched_via"),
        F.min("n_descendants").alias("n_descendants"),
    )
    return per.withColumn("is_approved", F.col("max_phase") >= 4)
