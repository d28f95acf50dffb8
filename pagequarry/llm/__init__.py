"""Operators for building text corpora: cleaning, near duplicates, mixing, encoding, search."""
