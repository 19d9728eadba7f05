"""Registered queries: the operators applied to the driver's tables, with SQL to check them."""

from . import codes, logs, search, stored, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "codes", "logs", "search", "stored", "texts"]
