from . import item_queries, search_queries, state_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "item_queries", "search_queries", "state_queries"]
