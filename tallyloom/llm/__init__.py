"""Training-corpus operators: packing, scans, deduplication, filters, sharding and counts.

Nothing outside this package imports it.
"""
