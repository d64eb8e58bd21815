"""Plans of the segment engine."""
