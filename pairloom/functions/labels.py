"""Labels of drug-condition pairs from relation counts and reporting statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relation names and signal thresholds.
EFFICACY = ("TREATS", "PREVENTS")
EFFICACY_NEGATED = ("NEG_TREATS", "NEG_PREVENTS")
HARM = ("CAUSES", "PREDISPOSES", "COMPLICATES")
HARM_NEGATED = ("NEG_CAUSES", "NEG_PREDISPOSES", "NEG_COMPLICATES")
NEUTRAL = ("AFFECTS", "ASSOCIATED_WITH", "DISRUPTS")
NEUTRAL_NEGATED = ("NEG_AFFECTS", "NEG_ASSOCIATED_WITH", "NEG_DISRUPTS")
RELATIONS = EFFICACY + EFFICACY_NEGATED + HARM + HARM_NEGATED + NEUTRAL + NEUTRAL_NEGATED
MIN_CASES, MIN_PRR, MIN_CHI_SQUARE = 3, 2.0, 4.0


def relation_count(relations: Column, name: str) -> Column:
    """Number behind ``name=`` in a ``;`` list; 0 if absent. A name never matches inside its negation."""
    return F.coalesce(F.regexp_extract(relations, rf"(?:^|;){name}=([0-9]+)", 1).try_cast("int"), F.lit(0))


def total(cols: list[Column]) -> Column:
    return reduce(Column.__add__, cols, F.lit(0))


def direction(asserted: Column, negated: Column) -> Column:
    """1 if only asserted, 0 if only negated, else null."""
    return F.when((asserted > 0) & (negated == 0), 1).when((negated > 0) & (asserted == 0), 0).cast("byte")


def signal(reported: Column, cases: Column, prr: Column, chi_square: Column, min_prr: float = MIN_PRR) -> Column:
    """Whether a pair clears the three thresholds; null if it was not reported or a figure is missing where the others pass."""
    return F.when(reported, (cases >= MIN_CASES) & (prr >= min_prr) & (chi_square >= MIN_CHI_SQUARE))


def signal_or_false(cases: Column, prr: Column, chi_square: Column) -> Column:
    """As ``signal``, with false for anything missing (NaN included)."""
    figures = ((cases, MIN_CASES), (prr, MIN_PRR), (chi_square, MIN_CHI_SQUARE))
    return reduce(Column.__and__, [F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")) >= y, F.lit(False)) for x, y in figures])


def alternative_labels(pairs: DataFrame, cases: str = "case_count", prr: str = "prr") -> DataFrame:
    """0/1 labels by other thresholds; a missing figure is below any."""
    at_least = lambda c, v: F.coalesce(F.col(c) >= v, F.lit(False))
    labels = {"prr2": at_least(prr, 2), "prr4_c5": at_least(prr, 4) & at_least(cases, 5), "cases10": at_least(cases, 10)}
    return pairs.withColumns({k: v.cast("int") for k, v in labels.items()})


def build_labels(pairs: DataFrame, relations: str = "relations") -> DataFrame:
    """Counts of every relation, both directional labels with their contradictions, and ``treats_and_causes``."""
    n = {r: F.col(f"n_{r.lower()}") for r in RELATIONS}
    out = pairs.withColumns({f"n_{r.lower()}": relation_count(F.col(relations), r) for r in RELATIONS})
    out = out.withColumns({f"{k}": total([n[r] for r in group]) for k, group in {"efficacy_asserted": EFFICACY, "efficacy_negated": EFFICACY_NEGATED, "harm_asserted": HARM, "harm_negated": HARM_NEGATED, "nondirectional_asserted": NEUTRAL}.items()})
    for kind in ("efficacy", "harm"):
        yes, no = F.col(f"{kind}_asserted"), F.col(f"{kind}_negated")
        out = out.withColumns({f"{kind}_label": direction(yes, no), f"{kind}_contradicted": (yes > 0) & (no > 0)})
    return out.withColumn("treats_and_causes", (F.col("efficacy_label") == 1) & (F.col("harm_label") == 1))


def relation_map(relations: Column) -> Column:
    """The whole ``;`` list as a map; names are trimmed, a bad number counts 0, the last of equal names wins."""
    entries = F.transform(F.filter(F.split(F.coalesce(relations, F.lit("")), ";"), lambda t: F.length(t) > 0), lambda t: F.struct(F.trim(F.substring_index(t, "=", 1)).alias("k"), F.coalesce(F.regexp_extract(t, r"=\s*([+-]?[0-9]+)\s*$", 1).try_cast("int"), F.lit(0)).alias("v")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(entries, lambda o, j: (o["k"] == e["k"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def sum_where(counts: Column, keep) -> Column:
    return F.aggregate(F.map_values(F.map_filter(counts, lambda k, v: keep(k))), F.lit(0), lambda a, v: a + v)


def sentence_sums(pairs: DataFrame, relations: str = "relations") -> DataFrame:
    """Sentences that assert harm, assert benefit, or negate anything."""
    parsed = pairs.withColumn("_map", relation_map(F.col(relations)))
    sums = {"harm_sentences": lambda k: k.isin(*HARM), "benefit_sentences": lambda k: k.isin(*EFFICACY), "negated_sentences": lambda k: k.startswith("NEG_")}
    return parsed.withColumns({name: sum_where(F.col("_map"), keep) for name, keep in sums.items()}).drop("_map")


def degrees(pairs: DataFrame, key: str, name: str, distinct: str | None = None) -> DataFrame:
    """Pairs per key, or distinct values of a column, and the log of 1 more."""
    count = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    return pairs.groupBy(key).agg(count.alias(name)).withColumn(f"log_{name}", F.log1p(name))


def disproportionality(pairs: DataFrame, drug: str = "drug", condition: str = "condition", reports: str = "a") -> DataFrame:
    """PRR and chi-square of each pair's 2x2 table; null where a margin is empty."""
    per_drug = pairs.groupBy(drug).agg(F.sum(reports).alias("n_drug"))
    per_condition = pairs.groupBy(condition).agg(F.sum(reports).alias("n_condition"))
    every = pairs.agg(F.sum(reports)).scalar()
    out = pairs.join(per_drug, drug).join(per_condition, condition).withColumn("n_all", every)
    a, d, c, n = (F.col(x).cast("double") for x in (reports, "n_drug", "n_condition", "n_all"))
    rest = (c - a) * d
    table = d * (n - d) * c * (n - c)
    gap = a * (n - d - c + a) - (d - a) * (c - a)
    return out.withColumns({"prr": F.when(rest > 0, a * (n - d) / rest), "chi_square": F.when(table > 0, n * gap * gap / table)})
