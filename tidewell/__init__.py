"""Hybrid-search analytics on PySpark: batch-of-queries search, indexing, event analytics and evaluation."""
