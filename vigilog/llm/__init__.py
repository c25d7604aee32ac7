"""Operators for training data: packing, scans, duplicates, mixing, search, extraction, scores."""
