"""Training-data operators: quality, near-duplicates, extraction, packing, archives.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
