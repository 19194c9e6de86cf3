"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``registry`` hands its
queries to ``__spark_entry__``.
"""
