"""Registered queries: each operator on the given tables, with equivalent SQL."""

from queries import classes, generalisers, models, noise  # noqa: F401
from queries.base import CATALOG

__all__ = ["CATALOG"]
