"""Streams of queries against a static catalogue."""
