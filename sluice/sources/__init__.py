"""Readers and writers of the lake and parsers of source payloads."""
