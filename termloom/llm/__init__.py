"""Operators for text-collection upkeep: encodings, near-duplicates, canonical forms, term counts, tokenizing, packing, subjects.

Nothing outside this subpackage imports it.
"""
