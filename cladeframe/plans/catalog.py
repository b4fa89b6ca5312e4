"""All registered queries."""

from __future__ import annotations

from . import q_growth, q_relational, q_sites, q_trees  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
