"""Operators of a training-data pipeline: search, filtering, deduplication, mixing, sharding and encoding.

Nothing else in the package imports this subpackage.
"""
