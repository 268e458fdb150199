"""Every module of queries, imported so that it registers itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment_queries, graph_queries, sequence_queries, source_queries, spectrum_queries, sql_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptide-spectrum search."""
    return QUERIES["pv6_psm_search"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
