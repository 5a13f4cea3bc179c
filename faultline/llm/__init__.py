"""Operators for text that becomes training data."""
