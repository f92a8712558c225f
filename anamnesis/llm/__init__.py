"""Operators for training-data pipelines, each a query over the given tables."""
