"""tickframe: price analytics over whole panels of symbols, written for Spark."""

from tickframe.session import get_session

__all__ = ["get_session"]
