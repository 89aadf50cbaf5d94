"""Temporal splits, cross-validation and search."""
