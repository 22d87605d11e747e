"""The registered queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbq.plans import checks, details, remember, runs, scores, work

_MODULES = [checks, scores, work, runs, remember, details]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["document_scorecard"](spark, sf_dir)
