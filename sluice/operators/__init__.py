"""Relational operators as pure DataFrame functions."""
