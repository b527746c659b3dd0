"""Named queries with their SQL oracles. A query's docstring names the operators that it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL that gives the same rows where there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import audits, cues, graphs, lifecycle, matching, pages, programs, progressions, records, resources, reviewed, reviews, scoring, searches, selections, statements, trees, understanding, units  # noqa: E402, F401
