"""All registered queries."""

from vacantia.plans import (  # noqa: F401
    catalog_cv,
    catalog_logs,
    catalog_postings,
    catalog_profile,
    catalog_streams,
    catalog_vectors,
)
from vacantia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
