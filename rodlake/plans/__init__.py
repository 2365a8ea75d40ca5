"""plans of rodlake."""
