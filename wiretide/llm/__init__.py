"""Operators for training-data pipelines: cleaning, de-duplication, scoring, mixing, sharding.

Nothing outside this folder imports it. ``queries.py`` registers one query for each operator.
"""
