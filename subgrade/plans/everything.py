"""All queries of the library and their SQL."""

from subgrade.plans import file_queries, polygon_queries, run_queries, site_queries  # noqa: F401 (they register their queries)
from subgrade.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
