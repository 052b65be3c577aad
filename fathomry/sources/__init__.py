"""Readers of the engine's tables."""

from .tables import table

__all__ = ["table"]
