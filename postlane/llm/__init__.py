"""Operators that prepare training data from document tables."""
