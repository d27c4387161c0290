"""Skein: retrieval, knowledge-graph and profile analytics as Spark DataFrame jobs."""
