"""Hybrid document search and code analytics on Spark."""
