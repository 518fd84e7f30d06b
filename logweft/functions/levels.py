"""Severity levels: normalisation, rank and export text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from ..schema import LEVELS

# Accepted spellings of each level (compared case-insensitively).
LEVEL_SPELLINGS = {
    "TRACE": "TRACE",
    "TRC": "TRACE",
    "DEBUG": "DEBUG",
    "DBG": "DEBUG",
    "INFO": "INFO",
    "INF": "INFO",
    "NOTICE": "NOTICE",
    "WARN": "WARN",
    "WARNING": "WARN",
    "WRN": "WARN",
    "ERROR": "ERROR",
    "ERR": "ERROR",
    "FATAL": "FATAL",
    "FTL": "FATAL",
    "CRITICAL": "FATAL",
    "CRIT": "FATAL",
}


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, key)


def normalize_level(c: Column) -> Column:
    """Level name of a spelling, NULL when it is none."""
    return _lookup(LEVEL_SPELLINGS, F.upper(c))


def level_rank(c: Column) -> Column:
    """0 (TRACE) to 6 (FATAL)."""
    return _lookup({name: rank for rank, name in enumerate(LEVELS)}, c)


def level_title(c: Column) -> Column:
    """Export form: ``Warn``."""
    return F.initcap(F.lower(c))


def rank_of(name: str) -> int:
    """Rank of a level spelling given by the caller."""
    level = LEVEL_SPELLINGS.get(name.strip().upper())
    if level is None:
        raise ValueError(f"unknown level {name!r}")
    return LEVELS.index(level)
