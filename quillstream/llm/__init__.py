"""Training-data operators: dedup, fingerprints, filters, tokens, archives and search.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when present.
"""
