"""The registered queries, the SQL that gives the same rows, and the writing of what they read."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES, prepare

__all__ = ["ORACLES", "QUERIES", "prepare"]
