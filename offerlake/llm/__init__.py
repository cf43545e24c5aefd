"""Operators for training data: scans, deduplication, decontamination, tokens."""
