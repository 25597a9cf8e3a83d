"""Journals, vector text and vector files."""
