"""Training-data operators: search, tokenising, deduplication, extraction, scoring, packing.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL; every other module is one operator.
"""
