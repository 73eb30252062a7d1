"""All queries and their SQL."""

from __future__ import annotations

from driftlog.plans import catalogue, checked, checked_sql, oracles, scaled, scaled_sql

assert checked and scaled  # their queries register themselves in the catalogue
QUERIES = catalogue.QUERIES
ORACLES = oracles.ORACLES | checked_sql.ORACLES | scaled_sql.ORACLES
#: The same results from tables that are laid out otherwise.
ORACLES |= {"laid_out_prompt_stats": ORACLES["prompt_stats"], "laid_out_denominator": ORACLES["canonical_denominator"]}
