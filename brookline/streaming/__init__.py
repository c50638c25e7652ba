"""Unbounded sources."""

from .generator import GeneratorSource

__all__ = ["GeneratorSource"]
