"""All named queries of the asset library with the SQL that each one is held against."""

from __future__ import annotations

from tidewall.plans import q_clean, q_evaluate, q_exposure, q_lines, q_models, q_series, q_sources, q_spatial, q_stats  # noqa: F401
from tidewall.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
