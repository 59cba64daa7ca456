"""Operators for training data: linkage, consensus, packing, contamination and language."""
