"""Training-data operators: search, deduplication, scoring, mixing, packing, encoding and sharding.

Nothing else in the package imports this subpackage.
"""
