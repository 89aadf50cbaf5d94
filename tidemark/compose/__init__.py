"""Pipelines, unions and column-wise composition of operators."""
