"""All registered queries, in survey order."""

from quotemill.plans import catalog_prepare, catalog_indicators, catalog_positions, catalog_streaming  # noqa: F401
from quotemill.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
