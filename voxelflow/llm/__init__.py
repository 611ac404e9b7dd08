"""Corpus operators for training-data pipelines, re-expressed Spark-first.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
