"""Training-data operators: token counts, search, deduplication, quality, language, packing and privacy.

Nothing outside this subpackage imports it.
"""
