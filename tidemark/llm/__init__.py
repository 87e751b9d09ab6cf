"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; :mod:`tidemark.llm.queries` holds the thin contract queries.
"""
