"""Operators of a training-data pipeline: quality, formatting, deduplication, mixing, packing and scoring of documents.

Nothing outside this folder imports it; ``lectern.llm.queries`` lists its queries.
"""
