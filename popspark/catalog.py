"""Named queries over the driver tables and the SQL that checks them."""

from popspark.queries import interval_queries, model_queries, window_queries
from popspark.queries.views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "interval_queries", "model_queries", "window_queries"]
