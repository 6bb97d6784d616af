"""The core's named queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litloom.plans import files, networks, packed, reference, works  # noqa: F401 - the modules enter their queries into those of reference

QUERIES = {"p3_found": packed.p3_found, "p3_delimiters": packed.p3_delimiters, **reference.QUERIES}
ORACLES: dict[str, str] = dict(reference.ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords used together in two papers or more."""
    return reference.keyword_cooccurrence(spark, sf_dir)
