"""Operators for training-data pipelines: text search, splitting, encoding and near-duplicates.

Nothing else in the library imports this subpackage.
"""
