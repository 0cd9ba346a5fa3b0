"""Operators for training-data pipelines: percentiles, neighbours, tokens, packing, shared passages."""
