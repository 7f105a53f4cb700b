"""Rank index of a sorted table (F2): any page from the partitions that hold it.

The table is written once in ranges of its order, with the number of rows
before each range.  A page reads the one or two ranges that it lies in, however
deep it is; nothing is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_rank_index(df: DataFrame, order: list[Column], path: str, rows_a_range: int = 100_000) -> None:
    """Write ``df`` by ``order``, a total order, to ``path``."""
    ranges = max(1, -(-df.count() // rows_a_range))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    dealt.write.partitionBy("range").parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/none")          # the columns, for a page that holds nothing
    # one row a range; the numbers are taken from what was written
    held = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy("range").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    (held.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges"))


def read_page(spark: SparkSession, path: str, order: list[Column], visible: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``visible`` with their position ``pos``."""
    ranges = spark.read.parquet(f"{path}/ranges")
    asked = ranges.where((F.col("before") < offset + visible) & (F.col("before") + F.col("held") > offset))
    found = [(r["range"], r["before"]) for r in asked.collect()]          # those of one page
    if not found:
        return spark.read.parquet(f"{path}/none").withColumn("pos", F.lit(0).cast("long"))
    rows = spark.read.parquet(f"{path}/rows")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    start = F.create_map(*(F.lit(x) for r in found for x in r))[F.col("range")]
    out = rows.where(F.col("range").isin([r for r, _ in found])).withColumn("pos", start + inside)
    return out.where((F.col("pos") > offset) & (F.col("pos") <= offset + visible)).drop("range")
