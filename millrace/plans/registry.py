"""All registered queries: importing a module of queries registers them."""

from millrace.plans import detail_queries, file_queries, governance_queries, listing_queries, parser_queries, source_queries, value_queries  # noqa: F401
from millrace.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
