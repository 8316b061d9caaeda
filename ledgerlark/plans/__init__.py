"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from .registry import ORACLES, QUERIES
from . import calendar, catalog, listing, linking, pages, programme, rules  # noqa: F401, E402, I001

__all__ = ["ORACLES", "QUERIES"]
