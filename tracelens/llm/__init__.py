"""Training-data operators: packing, mixing, quality, de-duplication, fingerprints, output and URL filtering.

Nothing outside this package imports it; `queries.py` here registers its queries.
"""
