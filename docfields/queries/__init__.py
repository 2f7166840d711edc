"""Registered queries: every operator over the given tables, with its checking SQL."""

from docfields.queries import dictionaries, layout, records, scalars, streams, tables, zone  # noqa: F401
from docfields.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
