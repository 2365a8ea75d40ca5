"""Operators for building training corpora.

Nothing outside this package imports it; ``__spark_entry__`` registers its queries
only when the package is present.
"""
