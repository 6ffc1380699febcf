"""All queries of the library outside llm, with the SQL that an independent engine can run for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import guards, lists, preparation, programs, ranges, scalars, scoring, segments, tokens, trees

MODULES = (lists, guards, ranges, trees, scoring, preparation, scalars, segments, programs, tokens)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
#: Queries that have no SQL; tests hold them against brute force.
ALONE: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in getattr(m, "ALONE", {}).items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
