"""Tidemark: point-in-time market and news analytics on Spark DataFrames."""

from tidemark.session import build_session, checkpointed

__all__ = ["build_session", "checkpointed"]
