"""Training-data preparation on Spark: deduplication, extraction, filters, tokens.

Nothing outside this subpackage imports it.
"""
