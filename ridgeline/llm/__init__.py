"""Training-data operators: scans, deduplication, packing, mixing and quality rules.

Nothing outside this folder imports it.
"""
