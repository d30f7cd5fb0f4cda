"""Training-data operators: quality, tokenisation, secrets, sharding, archives, deduplication.

Nothing outside this folder imports it. Each operator is a function on DataFrames with its own
parameters; ``queries.py`` holds the thin ``opN_<name>`` queries over the standard tables.
"""
