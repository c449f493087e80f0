"""Operators for building training data out of very large document tables."""
