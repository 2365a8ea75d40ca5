"""operators of rodlake."""
