"""Exact, repeatable stratified hold-out split (E6) without a whole-group sort.

Rows are ordered inside each (person, rating bin) stratum by
``md5(id:seed)`` then id; the first ``round(share * n)`` are held out.  A
window ``row_number`` over a stratum would sort a stratum holding a third of
all rows in one task, so the cut-off is found in two cheap passes instead:

1. count rows per (stratum, first 16 bits of the hash) -- at most 65,536
   small rows per stratum, combined map-side;
2. a running sum over those counts says how many rows lie in lower buckets;
3. rows are ranked inside their bucket (about n / 65,536 rows).

The result equals the full sort exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import HOLDOUT_SHARE, RATING_BINS, SPLIT_SEED


def rating_bin(c) -> F.Column:
    """Right-closed bins (0,3], (3,5], (5,7], (7,8], (8,10]; other values -> null."""
    r = F.col(c) if isinstance(c, str) else c
    expr = None
    for i in range(1, len(RATING_BINS)):
        lo, hi = RATING_BINS[i - 1], RATING_BINS[i]
        cond = (r > lo) & (r <= hi)
        expr = F.when(cond, i - 1) if expr is None else expr.when(cond, i - 1)
    return expr


def stratified_split(df: DataFrame, id_col: str = "title_id", rating_col: str = "rating",
                     by=("user_id",), share: float = HOLDOUT_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``bin`` and boolean ``is_test``; rows outside every bin are train."""
    by = list(by)
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    d = df.withColumns({"bin": rating_bin(rating_col), "_b": F.conv(F.substring(h, 1, 4), 16, 10).cast("int")})
    keys = by + ["bin"]
    counts = d.filter(F.col("bin").isNotNull()).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_b")          # <= 65,536 rows per stratum
    counts = (counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
                    .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
                    .withColumn("_k", F.round(F.col("_n") * share).cast("long")))
    sized = d.join(counts.select(*keys, "_b", "_before", "_k").hint("merge"), [*keys, "_b"], "left")
    # ranked where the join left them, one shuffle for both; the hash is made again, not carried
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(h, id_col))
    is_test = F.coalesce(F.col("_before") + rank <= F.col("_k"), F.lit(False))
    return sized.withColumn("is_test", is_test).drop("_b", "_before", "_k")
