"""Every registered query, grouped by the part of the inventory it covers."""

from taleloom.plans import (  # noqa: F401
    catalogue_queries,
    feature_queries,
    metric_queries,
    model_queries,
    page_queries,
    relational_queries,
    sampling_queries,
    storage_queries,
)
from taleloom.plans.registry import ORACLES, QUERIES  # noqa: F401
