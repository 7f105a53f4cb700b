"""Names of working columns beside the columns of a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, lengthened until no column of ``df`` begins with it in any case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return prefix
