"""Streaming of the segment engine."""
