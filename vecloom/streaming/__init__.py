"""Structured Streaming maintenance of journals and indexes."""
