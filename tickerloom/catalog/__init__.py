"""Every query of the repository, with its SQL form where SQL can say it."""

from tickerloom.catalog import feeds, fundamentals, merges, portfolio, prices, risk, store  # noqa: F401  (registration)
from tickerloom.catalog.base import QUERIES

__all__ = ["QUERIES"]
