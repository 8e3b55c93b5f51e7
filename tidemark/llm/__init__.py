"""Operators for text corpora: cleaning, near-duplicates, packing, formatting, tokens."""
