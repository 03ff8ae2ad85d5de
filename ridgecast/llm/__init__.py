"""Training-data operators: dedup, language ID, quality, mixing, packing and token output.

Nothing else in the library imports this subpackage.
"""
