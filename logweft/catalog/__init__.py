"""Registered queries over the test tables, one per operator."""

from . import aggregation, filtering, inputs, outputs, parsing, positions, spans, streams  # noqa: F401
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
