"""Functions of the segment engine."""
