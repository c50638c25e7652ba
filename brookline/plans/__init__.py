"""Logical pipelines and what carries their order."""
