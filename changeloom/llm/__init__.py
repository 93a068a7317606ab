"""Operators for training-data pipelines: formatting, dedup, search, packing, mixing, rules.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries.
"""
