"""Operators of large-scale training-data pipelines.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; `registry` holds the queries and their SQL.
"""
