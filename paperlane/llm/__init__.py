"""Operators that prepare training text: quality, deduplication, decontamination, packing and storage.

Nothing else in the package imports this subpackage.
"""
