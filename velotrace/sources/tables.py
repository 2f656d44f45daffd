"""Test tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READINGS = "opensensemap_overtaking_distances"
EDGES = "muenster_edges_classified"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
