"""Null and sentinel rules shared by every job (one place, one meaning)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("", "N/A")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c, sentinels=SENTINELS) -> Column:
    """Trimmed text, with blank and sentinel values turned into null."""
    t = F.trim(_c(c))
    return F.when(t.isin(*sentinels), F.lit(None).cast("string")).otherwise(t)


def is_failed(c) -> Column:
    """A result counts as failed when it is null or blank."""
    return _c(c).isNull() | (F.trim(_c(c)) == "")


def is_ok(c) -> Column:
    return ~is_failed(c)


def first_item(c, sep: str = ",") -> Column:
    """First trimmed item of a delimited list, null when blank."""
    return F.nullif(F.trim(F.split(F.coalesce(_c(c), F.lit("")), sep).getItem(0)), F.lit(""))


def split_list(c, sep: str = ",", drop=("", "N/A")) -> Column:
    """Delimited text -> array of trimmed items, empty items and sentinels removed."""
    items = F.transform(F.split(F.coalesce(_c(c), F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(items, lambda x: ~x.isin(*drop))


def dedupe(df: DataFrame, keys, order_cols, keep: str = "first") -> DataFrame:
    """One row per key by explicit input order.

    ``order_cols`` is a total order over input rows; ``keep='last'`` keeps the
    row that comes last.  Written as a ``min_by``/``max_by`` aggregate so the
    choice is combined map-side: a key holding a third of all rows is reduced
    to one row per map task before the shuffle, never sorted in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [order_cols] if isinstance(order_cols, (str, Column)) else list(order_cols)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[_c(o) for o in order_cols])
    pick = F.min_by if keep == "first" else F.max_by
    if not rest:
        return df.select(*keys).distinct()
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return out.select(*keys, *[F.col("_row." + c).alias(c) for c in rest]).select(*df.columns)


def all_of(preds) -> Column:
    return reduce(lambda a, b: a & b, preds)


def any_of(preds) -> Column:
    return reduce(lambda a, b: a | b, preds)

