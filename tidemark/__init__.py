"""Revisioned, indexed and watchable tables on Spark DataFrames."""
