"""All queries on the engine's own operators and their SQL."""

from mercadia.plans import account_queries, campaign_queries, detail_queries, ingest_queries, matching_queries
from mercadia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "account_queries", "campaign_queries", "detail_queries", "ingest_queries", "matching_queries"]
