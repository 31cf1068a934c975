"""Subpackage of the tabular engine."""
