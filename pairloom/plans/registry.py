"""Queries and their DuckDB equivalents, gathered from the plan modules."""

from . import analysis, evidence, features, models, sources, trials

PLANS = (evidence, analysis, features, models, sources, trials)
QUERIES = {name: q for plan in PLANS for name, q in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
