"""All queries by name, and their SQL."""

from linkspan.plans.queries import ORACLES, QUERIES

FLAGSHIP = "fine_rank_100"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
