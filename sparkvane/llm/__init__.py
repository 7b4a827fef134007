"""Operators that prepare a large text corpus. Nothing else in the package imports this."""
