"""functions of rodlake."""
