"""Registered queries over the test tables."""

from tickframe.plans import coins, files, mentions, models, series
from tickframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "coins", "files", "mentions", "models", "series"]
