"""Imports every catalogue module so that its queries are registered."""

from catalog import accounts, evaluation, features, policy, portfolio, stores  # noqa: F401
from catalog.registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["ORACLES", "QUERIES"]
