"""Sources of the segment engine."""
