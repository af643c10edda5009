"""Training-data operators: deduplication, filtering, decontamination, packing and counting.

Nothing else in the library imports this subpackage.
"""
