"""All registered queries."""

from fieldgauge.plans import catalog_clean, catalog_coverage, catalog_evidence, catalog_profile, catalog_samples, catalog_stream  # noqa: F401
from fieldgauge.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
