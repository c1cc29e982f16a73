"""Operators that prepare text corpora for training: duplicates, quality, mixing, packing."""
