"""Operators of a training-data pipeline: scoring, deduplication, redaction, tokens and packing.

Nothing outside this package imports it. Every operator takes DataFrames and keeps the work in Spark tasks; the queries
over the driver tables are in ``corpuskit.llm.queries``.
"""
