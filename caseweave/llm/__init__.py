"""Training-data operators: packing, deduplication, media columns, sharding, scoring and mixing.

Nothing outside this subpackage imports it.
"""
