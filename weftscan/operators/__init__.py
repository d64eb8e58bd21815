"""Operators of the segment engine."""
