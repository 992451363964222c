"""Operators of a training-data pipeline: deduplication, tokenisers, filters, mixing, sharding.

``queries.py`` registers one query per operator; nothing outside this folder imports it
except the guarded hook of the entry module and the corpus pipeline.
"""
