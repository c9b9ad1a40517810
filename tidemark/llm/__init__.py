"""Operators a training-data pipeline needs, their queries and SQL.  Nothing outside this folder imports it."""
