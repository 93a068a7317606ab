"""Registered queries: one per row of the coverage list, each with its SQL where one exists."""

from __future__ import annotations

from . import (aggregates, changes, flows, joins, messages, patterns, projections,  # noqa: F401
               scalars, sinks, streams)
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
