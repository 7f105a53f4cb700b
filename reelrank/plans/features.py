"""Feature jobs: training-row cleaning, the feature matrix, text vectors and
tag interactions (B1, I1, I2, I7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_FILL = ["director", "actors", "studio", "genre", "language", "source", "writer"]


def clean_training_rows(df: DataFrame, text_cols=TEXT_FILL) -> DataFrame:
    """B1: drop null rating / plot and plot ``N/A``; fill text columns with ``Unknown``."""
    out = df.filter(F.col("rating").isNotNull() & F.col("plot").isNotNull()
                    & (F.trim("plot") != "N/A"))
    present = [c for c in text_cols if c in df.columns]
    return out.na.fill("Unknown", subset=present)
