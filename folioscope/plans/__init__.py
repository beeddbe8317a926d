"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import answers, changes, flow, reference, runs, scalars  # noqa: F401
from .base import ORACLE_SQL, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE_SQL)
