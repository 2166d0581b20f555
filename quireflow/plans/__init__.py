"""Queries over the test tables."""

from . import books as _books  # noqa: F401  registers its queries
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
