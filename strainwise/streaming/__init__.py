"""Structured Streaming versions of roster scoring and breakdowns."""
