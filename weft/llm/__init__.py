"""Training-data operators: deduplication, quality, privacy, tokens, packing.

Nothing else in the package imports this folder; ``__spark_entry__`` adds its
queries when it can be imported.
"""
