"""Sinks: versioned catalog writes (A4) and model artifacts.

Nothing is overwritten in place: each write goes to a new ``v=N`` folder and
is marked complete with ``_SUCCESS``; readers take the newest complete
version, so a job that dies half-way leaves the previous version intact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.incremental import _children


def write_catalog(df: DataFrame, catalog_dir: str) -> int:
    """A4 (write): write a new version and return its number."""
    spark = df.sparkSession
    versions = _children(spark, catalog_dir, "v=")
    v = (versions[-1] + 1) if versions else 0
    df.write.mode("errorifexists").parquet(f"{catalog_dir}/v={v}")
    return v


def read_catalog(spark: SparkSession, catalog_dir: str) -> DataFrame:
    """A4 (read): the newest complete version."""
    versions = _children(spark, catalog_dir, "v=")
    if not versions:
        raise FileNotFoundError(catalog_dir)
    return spark.read.parquet(f"{catalog_dir}/v={versions[-1]}")


def write_artifacts(artifact_dir: str, tables: dict[str, DataFrame], by: str = "user_id") -> None:
    """Save side tables of a model (entity statistics, feature names,
    training meta with vectors) as Parquet, partitioned by person when the
    table has a person column."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if by in df.columns:
            w = w.partitionBy(by)
        w.parquet(f"{artifact_dir}/{name}")
