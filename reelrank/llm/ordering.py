"""Total orders and running sums over partitions of any number.

Both helpers keep every step distributed: the only table whose size does not
follow the rows is the list of (partition, group) totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

PARTITION = "_part"


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """Deal rows to partitions by range of ``order`` and sort each partition.

    Adds ``_part``, whose order is the order of the ranges.  The result is
    checkpointed: sampled range bounds could differ if a lost executor made
    Spark sample again, so what is built on ``_part`` must read one result.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpoint(dealt.withColumn(PARTITION, F.spark_partition_id()))


def running_sums(ordered: DataFrame, order: list[Column], sums: dict[str, Column],
                 group: list[str] | None = None) -> DataFrame:
    """Exclusive prefix sums of ``sums`` along ``order``, restarted per group.

    ``ordered`` comes from :func:`in_order`; ``group`` columns hold no null
    and lead the order.  Partition totals are summed over partitions (at most
    partitions + groups rows), running sums stay inside a partition.
    """
    keys = [PARTITION, *(group or [])]
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(PARTITION).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = ordered.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    offsets = totals.select(*keys, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}")
                                     for n in sums))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return (local.join(offsets, keys)
            .withColumns({n: F.col(n) + F.col(f"_off_{n}") for n in sums})
            .drop(*(f"_off_{n}" for n in sums)))
