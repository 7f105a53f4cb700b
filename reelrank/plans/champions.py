"""Model registry: metrics and side tables of every version, and the pointer to
each person's current model (I6, A9, A10).

``base`` holds ``model_metrics`` (rows appended per version), ``artifacts/<version>``
(entity statistics, feature names, history with vectors, ...) and
``current_model``, a versioned table of one row a person.  The pointer moves for
a person only if the newer version is better for that person; it is published
after everything it points to is written, and two submissions at once are
settled by the store's manifest: the later one is judged against the earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import write_artifacts
from ..streaming.store import BucketStore
from .model import promote_if_better, write_metrics

POINTER = "user_id string, model_version string, model_path string, mae double, r2 double"


def _store(spark: SparkSession, base: str) -> BucketStore:
    return BucketStore(spark, f"{base}/current_model", "user_id")


def current_models(spark: SparkSession, base: str) -> DataFrame:
    """user_id, model_version, model_path, mae, r2 of each person's current model."""
    rows = _store(spark, base).rows()
    return spark.createDataFrame([], POINTER) if rows is None else rows


def submit(spark: SparkSession, base: str, version: str, metrics: DataFrame, model_path: str,
           side_tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Save a fitted version and move the pointer where it is better.

    metrics: user_id, n, mae, rmse, r2.  Returns the pointer rows that moved."""
    write_artifacts(f"{base}/artifacts/{version}", side_tables or {})
    write_metrics(metrics, f"{base}/model_metrics", version)
    saved = spark.read.parquet(f"{base}/model_metrics").where(F.col("model_version") == version)

    def better(current: DataFrame | None) -> DataFrame:
        held = spark.createDataFrame([], POINTER) if current is None else current
        accepted = promote_if_better(saved, held).where("promote").select("user_id")
        return saved.join(accepted, "user_id").select(
            "user_id", "model_version", F.lit(model_path).alias("model_path"), "mae", "r2")
    return _store(spark, base).upsert_from(better)


def saved_metrics(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/model_metrics")


def saved_table(spark: SparkSession, base: str, version: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/artifacts/{version}/{name}")
