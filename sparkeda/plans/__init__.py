"""Registered queries and their SQL."""

from sparkeda.plans import anomaly_queries, catalog_queries, clustering_queries, profile_queries, quality_queries, reporting_queries, schema_queries, supervised_queries, timeseries_queries  # noqa: F401
from sparkeda.plans.registry import ORACLES, QUERIES  # noqa: F401
