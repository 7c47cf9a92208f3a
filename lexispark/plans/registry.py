"""Every query of the engine with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.plans import contracts, details, enrichment, files, highlights, quizzes, stores, study, vocabulary

MODULES = (vocabulary, study, enrichment, quizzes, contracts, stores, files, details, highlights)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
