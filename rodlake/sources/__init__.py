"""sources of rodlake."""
