"""Feature steps that are fit on train rows and applied to others, nested records made flat, and tables of figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xref
from ..sources.shared import keep
from .joins import lookup
from .metrics import macro_auc
from .statistics import floor_scores

MISSING, OTHER = "__missing__", "other"
#: Terms and genes of one code that meet in a cell, and pairs of a task, at about most; and tasks at most.
IDS_A_CELL, GENES_A_CELL, PAIRS_A_TASK, MOST_TASKS = 4096, 1024, 20_000_000, 4096
#: Term identifiers of diseases (fixed values).
DISEASES = ("MONDO:", "EFO:", "Orphanet:", "DOID:")


# ---- fit on train, apply to any rows


def fit_levels(train: DataFrame, column: str, cap: int, bucket_tail: bool = True) -> list[str]:
    """Levels of a column, at most ``cap`` of them: all, or the most frequent and ``other``; none where the tail may not be bucketed.

    Null is a level of its own beside them.
    """
    counts = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).count()
    top = [r.level for r in counts.orderBy(F.desc("count"), "level").limit(cap + 1).collect()]  # cap + 1 values
    if len(top) <= cap:
        return sorted(top)
    return [*sorted(top[: cap - 1]), OTHER] if bucket_tail else []


def level_columns(df: DataFrame, column: str, levels: list[str], prefix: str) -> DataFrame:
    """A 0/1 column for each train level and for missing; a value that train lacks is ``other``, or nothing if train had no tail."""
    known = [v for v in levels if v != OTHER]
    value = F.when(F.col(column).isNull(), MISSING).when(F.col(column).isin(known), F.col(column)).otherwise(OTHER)
    return df.withColumns({f"{prefix}_{v}": (value == v).cast("int") for v in [*levels, MISSING]})


def fit_medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the train median of each column, 0 for a column without values."""
    return train.agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(c) for c in columns])


def fill_medians(df: DataFrame, medians: DataFrame, flag: bool = False) -> DataFrame:
    """Missing and NaN values take the train medians; with ``flag`` a column says where."""
    out = df
    for c in medians.columns:
        missing = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        out = out.withColumn(f"{c}_missing", missing) if flag else out
        out = out.withColumn(c, F.when(missing, medians.select(c).scalar()).otherwise(F.col(c)))
    return out


def bucket(value: Column, names: dict[str, tuple[float | None, float | None]], otherwise: str | None = None) -> Column:
    """The name whose closed range holds the value; an open end is None."""

    def inside(low: float | None, high: float | None) -> Column:
        ends = ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
        return reduce(Column.__and__, ends)

    return reduce(lambda c, k: c.when(inside(*names[k]), F.lit(k)), names, F).otherwise(F.lit(otherwise))


CASES = {"3-5": (3, 5), "6-20": (6, 20), "21+": (21, None)}
NEIGHBOURS = {"0": (None, 0), "1-2": (1, 2), "3-5": (3, 5), "6+": (6, None)}


def count_weight(df: DataFrame, count: str, name: str) -> DataFrame:
    """Specificity of a count: log of all rows over those that share it."""
    every = df.agg(F.count(F.lit(1))).scalar()
    shared = df.groupBy(count).agg(F.log(every / F.count(F.lit(1))).alias(name))
    return df.join(shared.withColumnRenamed(count, "_c"), F.col(count).eqNullSafe(F.col("_c")), "left").drop("_c")


def incumbent(pairs: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """A known score of each pair and its log where above 0; pairs without one have nulls."""
    out = lookup(pairs, scores.select(*keys, score), keys)
    return out.withColumn(f"log_{score}", F.when(F.col(score) > 0, F.log(score)))


def design(pairs: DataFrame, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """A star of attribute tables round the pairs, a row for each pair."""
    return reduce(lambda df, t: lookup(df, *t), tables, pairs)


# ---- nested records


def wide_records(df: DataFrame, id_col: str, records: str, name: Column, value: Column, names: list[str]) -> DataFrame:
    """A column for each of ``names``: the value of the record ``r`` so named (the largest of several); null without one."""
    each = df.select(id_col, F.explode(records).alias("r")).select(id_col, name.alias("_name"), value.alias("_value"))
    return df.select(id_col).distinct().join(each.groupBy(id_col).pivot("_name", names).agg(F.max("_value")), id_col, "left")


def slug(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_")


def united(df: DataFrame, key: str, column: str, sep: str = "|", limit: int | None = None) -> DataFrame:
    """The union of the separated values of all rows of a key, sorted and joined again, cut to ``limit`` characters."""
    each = df.select(key, F.explode(F.split(column, F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")))).alias("v")).where("v <> ''")
    joined = F.array_join(F.sort_array(F.collect_set("v")), sep)
    return df.select(key).distinct().join(each.groupBy(key).agg((F.substring(joined, 1, limit) if limit else joined).alias(column)), key, "left").select(key, F.coalesce(column, F.lit("")).alias(column))


def map_pairs(df: DataFrame, column: str, key: str, value: str, kind: str = "bigint") -> DataFrame:
    """``key, value`` rows of JSON objects whose values are arrays."""
    parsed = df.select(F.explode(F.from_json(column, f"map<string,array<{kind}>>")).alias(key, "_values"))
    return parsed.select(key, F.explode("_values").alias(value)).distinct()


def molecules(records: DataFrame, parents: DataFrame, fields: list[str], routes: list[str]) -> DataFrame:
    """Molecules with the parent's value where their own is null or empty, the number of known routes and their class prefixes.

    ``records`` and ``parents``: molecule (parents: parent_id), fields and
    routes, ``classes`` (array of codes). A number of routes is null where none is known.
    """
    own = records.join(parents.select(F.col("molecule").alias("parent_id"), *[F.col(c).alias(f"_p_{c}") for c in [*fields, *routes, "classes"]]), "parent_id", "left")
    taken = {c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_p_{c}")) for c in [*fields, *routes]}
    classes = F.when(F.size(F.coalesce("classes", F.array())) > 0, F.col("classes")).otherwise(F.coalesce("_p_classes", F.array()))
    out = own.withColumns({**taken, "classes": classes})
    known = reduce(Column.__or__, [F.col(c).isNotNull() for c in routes])
    summed = reduce(Column.__add__, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in routes])

    def prefixes(n: int) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform("classes", lambda x: F.substring(x, 1, n)))), "|")

    return out.withColumns({"n_routes": F.when(known, summed), "n_classes": F.size("classes"), "class_1": prefixes(1), "class_4": prefixes(4)}).drop(*[c for c in out.columns if c.startswith("_p_")])


def within_limits(limits: dict[str, float]) -> Column:
    """Whether every figure is known and at most its limit."""
    return reduce(Column.__and__, [F.coalesce(F.col(c).cast("double") <= v, F.lit(False)) for c, v in limits.items()])


# ---- routes and terms


def id_routes(drugs: DataFrame, drug: str, direct: str, parent: str) -> DataFrame:
    """``molecule, drug`` by a drug's own molecule or its parent's."""
    ways = [drugs.select(F.col(c).alias("molecule"), drug) for c in (direct, parent)]
    return ways[0].unionByName(ways[1]).dropna().distinct()


def target_edges(edges: DataFrame, relation: str = "component", efficacy: str | None = "efficacy") -> DataFrame:
    """Targets that are no members of a complex or family, and, where asked for, of which efficacy is known to come."""
    from ..functions.text import truth

    out = edges.where(~F.coalesce(F.upper(relation).rlike("COMPLEX|FAMILY"), F.lit(False)))
    return out.where(truth(F.col(efficacy))) if efficacy else out


def is_disease(term: Column) -> Column:
    return reduce(Column.__or__, [term.startswith(p) for p in DISEASES])


def genes_by_code(xrefs: DataFrame, genes: DataFrame, sources: tuple[str, ...] = ("OMIM", "Orphanet")) -> DataFrame:
    """``id, gene, association`` of the terms whose cross reference (``id, source, code``) a gene's disease code names.

    The rows of a frequent code are pairs of its terms and genes: both are
    dealt over a grid of cells by hashes, and tasks are as many as the pairs
    need, so that none has all pairs of a code.
    """
    on = ["source", "code"]
    named = keep(genes.withColumn("_x", xref(F.col("disease"))).where("_x is not null").select(F.col("_x.source").alias("source"), F.col("_x.code").alias("code"), "gene", "association"), "genes")
    known = xrefs.where(F.col("source").isin(*sources)).select("id", *on)
    sizes = known.groupBy(*on).agg(F.count(F.lit(1)).alias("_ids")).join(named.groupBy(*on).agg(F.count(F.lit(1)).alias("_genes")), on)
    wide, high = (F.ceil(F.col(c) / most).cast("int") for c, most in (("_ids", IDS_A_CELL), ("_genes", GENES_A_CELL)))
    grid = keep(sizes.select(*on, wide.alias("_wide"), high.alias("_high"), (F.col("_ids") * F.col("_genes")).alias("_pairs")), "grid")
    tasks = max(1, min(MOST_TASKS, -(-int(grid.agg(F.sum("_pairs")).first()[0] or 0) // PAIRS_A_TASK)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known.join(grid, on).select("id", *on, place("id", "_wide").alias("_i"), each("_high").alias("_j"))
    right = named.join(grid, on).select("gene", "association", *on, place("gene", "_high").alias("_j"), each("_wide").alias("_i"))
    cell = [*on, "_i", "_j"]
    return left.repartition(tasks, *cell).join(right.repartition(tasks, *cell).hint("shuffle_hash"), cell).select("id", "gene", "association")


def phenotype_pairs(rows: DataFrame, disease: str, phenotype: str) -> DataFrame:
    """``disease, phenotype`` where both are what they should be, ids with colons."""
    from ..functions.text import colon_id

    pairs = rows.select(colon_id(F.col(disease)).alias("disease"), colon_id(F.col(phenotype)).alias("phenotype"))
    return pairs.where(is_disease(F.col("disease")) & F.col("phenotype").startswith("HP:"))


# ---- tables of figures


def coverage(conditions: DataFrame, condition_genes: DataFrame, targets: DataFrame, unmatched: str = "0_unmatched") -> DataFrame:
    """``total, mapped, with_genes, with_target``: how far conditions are mapped, have genes and share one with a drug."""
    figures = conditions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.coalesce(F.col("tier") != unmatched, F.lit(True)), 1)).alias("mapped"),
        F.count(F.when(F.coalesce("n_genes", F.lit(0)) > 0, 1)).alias("with_genes"),
    )
    shared = condition_genes.join(targets.select("gene").where("gene is not null").distinct(), "gene", "left_semi")
    return figures.withColumn("with_target", shared.agg(F.count_distinct("condition")).scalar())


def overlap_share(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``n_left, n_right, n_both, share``: distinct keys of both sides and the percentage of the left that the right has."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    counts = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full").agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count(F.col("_a") + F.col("_b")).alias("n_both"))
    return counts.withColumn("share", F.when(F.col("n_left") > 0, F.bround(100 * F.col("n_both") / F.col("n_left"), 1)))


def potency_contrast(pairs: DataFrame, panel: DataFrame, sets: DataFrame, least: int = 5, potent: float = 6.0) -> DataFrame:
    """``target, rate_hi, rate_lo, diff, n_hi, n_lo``: label rates of potent and other drugs over a target's conditions.

    Potent is the target's median affinity or more, and ``potent`` where any
    drug reaches it. Targets of fewer than ``least`` drugs, or pairs on either side, are left out.
    """
    known = panel.where("affinity is not null")
    cut = known.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.percentile("affinity", 0.5).alias("_m"), F.max("affinity").alias("_top")).where(F.col("_n") >= least)
    level = F.when(F.col("_top") >= potent, F.greatest(F.lit(potent), F.col("_m"))).otherwise(F.col("_m"))
    marked = known.join(cut, "target").select("target", "drug", (F.col("affinity") >= level).alias("_hi"))
    rows = pairs.join(marked, "drug").join(sets, ["target", "condition"], "left_semi")
    y = F.col("y").cast("double")
    out = rows.groupBy("target").agg(F.avg(F.when(F.col("_hi"), y)).alias("rate_hi"), F.avg(F.when(~F.col("_hi"), y)).alias("rate_lo"), F.count(F.when(F.col("_hi"), 1)).alias("n_hi"), F.count(F.when(~F.col("_hi"), 1)).alias("n_lo"))
    return out.where((F.col("n_hi") >= least) & (F.col("n_lo") >= least)).select("target", "rate_hi", "rate_lo", (F.col("rate_hi") - F.col("rate_lo")).alias("diff"), "n_hi", "n_lo")


def floor_table(populations: dict[str, tuple[DataFrame, DataFrame] | None], labels: list[str], eligible: tuple[int, ...] = (20,)) -> DataFrame:
    """One row per population, label and eligibility: the floor's macro AUC, drugs, train prevalence and a status.

    A population that is absent, a label that it lacks or that has one class
    in train is a row with a ``skipped:`` status and no figures.
    """
    rows = []
    for name, folds in populations.items():
        for label in labels:
            for least in eligible:
                key = [F.lit(name).alias("population"), F.lit(label).alias("label"), F.lit(least).alias("eligibility")]
                if folds is None or label not in folds[0].columns or label not in folds[1].columns:
                    spark = next(f for f in populations.values() if f)[0].sparkSession
                    status = "skipped: population not available" if folds is None else "skipped: label column not present"
                    rows.append(spark.range(1).select(*key, F.lit(status).alias("status"), F.lit(None).cast("double").alias("macro_auc"), F.lit(None).cast("long").alias("n_groups"), F.lit(None).cast("double").alias("prevalence")))
                    continue
                train, held = (f.withColumn("y", F.col(label).cast("int")) for f in folds)
                classes = train.agg(F.count_distinct("y").alias("k"), F.avg(F.col("y").cast("double")).alias("prevalence"))
                figures = macro_auc(floor_scores(train, held), min_pairs=least)
                good = F.col("k") >= 2
                both = figures.withColumns({"k": classes.select("k").scalar(), "p": classes.select("prevalence").scalar()})
                rows.append(both.select(*key, F.when(good, "ok").otherwise("skipped: single class in train").alias("status"), *[F.when(good, F.col(c)).alias(c) for c in ("macro_auc", "n_groups")], F.when(good, F.col("p")).alias("prevalence")))
    return reduce(DataFrame.unionByName, rows)


def rung_figures(rungs: DataFrame, drugs: DataFrame, kind: str, numbers: list[str], main: str, top: int = 5) -> DataFrame:
    """Per rung: drugs, how many and what percentage of the ``main`` kind, medians of numbers and its most frequent kinds."""
    rows = rungs.join(drugs, "drug", "left")
    figures = rows.groupBy("rung").agg(
        F.count(F.lit(1)).alias("n_drugs"),
        F.count(F.when(F.col(kind) == main, 1)).alias("n_main"),
        F.avg((F.coalesce(F.col(kind) == main, F.lit(False))).cast("double")).alias("share_main"),
        *[F.percentile(c, 0.5).alias(f"median_{c}") for c in numbers],
    )
    counts = rows.groupBy("rung", F.coalesce(kind, F.lit("null")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("rung").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "k"))), 1, top).alias("x"))
    return figures.join(ranked.select("rung", F.array_join(F.transform("x", lambda x: F.concat_ws("=", x["k"], (-x["o"]).cast("string"))), "|").alias("top_kinds")), "rung")


def outcome_counts(reference: DataFrame, least: int, outcome: str = "condition", y: str = "y") -> DataFrame:
    """``n, n_pos, n_neg, qualifies`` of each outcome of a reference set."""
    per = reference.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos"))
    per = per.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    return per.withColumn("qualifies", (F.col("n") >= least) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def scorer_table(rows: DataFrame, scorers: list[str], group: str = "drug", y: str = "y", least: int = 20) -> DataFrame:
    """``scorer, macro_auc, n_groups`` of several score columns over the same rows."""
    from .metrics import group_auc

    long = rows.unpivot([group, y], scorers, "scorer", "score").withColumn("_g", F.struct("scorer", group))
    per = group_auc(long, "_g", y, "score", least)
    return per.groupBy(F.col("_g.scorer").alias("scorer")).agg(F.avg("auc").alias("macro_auc"), F.count(F.lit(1)).alias("n_groups"))


# ---- invariants


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``; an error if it has more or fewer rows than ``before`` (as after a join that must not multiply)."""
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"{m} rows where {n} were expected")
    return after


def near_rate(rows: DataFrame, y: str, expected: float, tolerance: float) -> float:
    """The rate of a label; an error if it is off by more than the tolerance."""
    rate = rows.agg(F.avg(F.col(y).cast("double"))).first()[0]
    if rate is None or abs(rate - expected) > tolerance:
        raise ValueError(f"rate of {y} is {rate}, expected {expected} within {tolerance}")
    return rate
