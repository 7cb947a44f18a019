"""All registered queries."""

from tidemark.plans import backtests, books, labels, replays, rollups, survival
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "backtests", "books", "labels", "replays", "rollups", "survival"]
