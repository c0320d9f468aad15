"""Operators of a large-scale training-data pipeline.

Every operator is a function from DataFrames to DataFrames.  ``queries.py`` registers the thin
``opN_*`` queries over the driver's tables and their SQL.
"""
