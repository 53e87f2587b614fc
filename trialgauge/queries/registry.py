"""All registered queries, keyed by inventory id and a short name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .sqlkit import oracle

Query = Callable[[SparkSession, str], DataFrame]

SECTIONS = (
    "sources",
    "cleaning",
    "joins",
    "exploration",
    "features",
    "quality",
    "rankings",
    "benchmarks",
    "anomalies",
    "clusters",
    "graphs",
    "search",
    "golden",
    "rollups",
)


def _sections():
    return [import_module(f"{__package__}.{name}") for name in SECTIONS]


def queries() -> dict[str, Query]:
    return {k: v for module in _sections() for k, v in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: oracle(sql, **local) for module in _sections() for k, (sql, local) in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import at_risk_sites

    return at_risk_sites(spark, sf_dir)
