"""All registered queries: name -> (query, oracle SQL or None)."""
from __future__ import annotations

from ..operators.profile import profile
from . import aggregate_checks, edge_checks, label_checks, rows, run_checks

CHECKS = {**rows.CHECKS, **label_checks.CHECKS, **aggregate_checks.CHECKS,
          **run_checks.CHECKS, **edge_checks.CHECKS}


def flagship(spark, folder):
    return profile(rows.mc(spark, folder))
