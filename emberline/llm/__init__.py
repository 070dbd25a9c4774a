"""Operators for the making of training data. Nothing outside this package imports it."""
