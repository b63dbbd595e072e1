"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries and the DuckDB statements they are checked against.
"""
