"""Operators for large text and training-data jobs. Nothing outside this package imports it."""
