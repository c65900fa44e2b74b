"""Registered queries over the test tables, and their SQL counterparts."""

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
