"""Operators for building training data from web-scale document tables."""
