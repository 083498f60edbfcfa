"""Operators for large-scale preparation of training text. Nothing outside this subpackage imports it."""
