"""Joins and set operations of the incremental pipeline
(C1-C5, C8, C12, C14, C15, G1-G7, F4).

All membership tests are ``left_anti`` / ``left_semi`` joins (never
``NOT IN``: a null key must not silently empty the result), and "keep first /
last" is always by an explicit order column (``dedupe``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import dedupe, is_failed, is_ok
from ..functions.parse import severity_ordinal
from ..functions.fixed import GUIDE_COLUMNS


def _one_row(df: DataFrame, *key: str) -> DataFrame:
    """One row per key of a lookup table, so that a join cannot multiply rows:
    the last by ``_ord`` where the table has it, else the least row."""
    if "_ord" in df.columns:
        return dedupe(df, list(key), "_ord", keep="last")
    rest = [c for c in df.columns if c not in key]
    return dedupe(df, list(key), rest, keep="first")


def join_cast_studio(titles: DataFrame, enrich: DataFrame | None, key="title_id") -> DataFrame:
    """Left join cast list and studio; missing -> ""; absent table -> empty columns."""
    if enrich is None:
        return titles.withColumns({"actors_rt": F.lit(""), "studio_rt": F.lit("")})
    e = _one_row(enrich, key).select(key, F.col("actors_rt"), F.col("studio").alias("studio_rt"))
    out = titles.join(e, key, "left")
    return out.withColumns({"actors_rt": F.coalesce("actors_rt", F.lit("")),
                            "studio_rt": F.coalesce("studio_rt", F.lit(""))})


def join_tags(titles: DataFrame, tags_long: DataFrame, columns: list[str], key="title_id") -> DataFrame:
    """One 0/1 column per tag column name; missing -> 0.

    ``tags_long`` has (title_id, column); the pivot values are the fixed
    column list, so the pivot is a single grouped aggregate.
    """
    wide = (tags_long.filter(F.col("column").isin(columns))
                     .groupBy(key).pivot("column", columns).agg(F.lit(1)))
    out = titles.join(wide, key, "left")
    return out.na.fill(0, subset=columns)


def join_guide(titles: DataFrame, guide: DataFrame, key="title_id", default: int = -1,
               cols=GUIDE_COLUMNS) -> DataFrame:
    """Left join the five severities, map to ordinals, missing -> ``default``."""
    g = _one_row(guide, key).select(key, *[F.col(c).alias("_g_" + c) for c in cols])
    out = titles.join(g, key, "left")
    return out.select(*titles.columns,
                      *[severity_ordinal(F.col("_g_" + c), default).alias("pg_" + c) for c in cols])


def pending(all_rows: DataFrame, done: DataFrame, key="title_id", result_col: str | None = None) -> DataFrame:
    """C4: rows of ``all_rows`` without a successful row in ``done``."""
    ok = done if result_col is None else done.filter(is_ok(result_col))
    return all_rows.join(ok.select(key).distinct(), key, "left_anti")


def retry_set(all_rows: DataFrame, done: DataFrame, result_col: str, key="title_id") -> DataFrame:
    """Rows whose earlier result failed (null or blank)."""
    return all_rows.join(done.filter(is_failed(result_col)).select(key).distinct(), key, "left_semi")


def attach_scores_to_hits(hits: DataFrame, scores: DataFrame, n: int = 10, order=("rank", "title_id"),
                          key="title_id", query_col="query_id") -> DataFrame:
    """Left join catalog scores onto the first ``n`` search hits of every
    query (a per-query window limit, applied map-side before the shuffle).
    ``scores`` may hold a row for each person (``user_id``); of rows that
    repeat a title, or title and person, one counts."""
    w = Window.partitionBy(query_col).orderBy(*order)
    top = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return top.join(_one_row(scores, *[c for c in (key, "user_id") if c in scores.columns]), key, "left")


def reuse_or_refetch(listing: DataFrame, cache: DataFrame, extended: list[str],
                     key="title_id") -> DataFrame:
    """Listing rows -> status new / refresh / reuse; refresh first.

    ``refresh`` = cached but some extended field missing; rows without an id
    stay in the listing with status ``no_id`` and are never fetched.
    """
    c = _one_row(cache, key).select(key, F.lit(True).alias("_cached"), *[F.col(x).alias("_x_" + x) for x in extended])
    missing = F.lit(False)
    for x in extended:
        missing = missing | F.col("_x_" + x).isNull()
    j = listing.join(c, key, "left")
    status = (F.when(F.col(key).isNull(), "no_id")
               .when(F.col("_cached").isNull(), "new")
               .when(missing, "refresh").otherwise("reuse"))
    prio = F.when(status == "refresh", 0).when(status == "new", 1).when(status == "reuse", 2).otherwise(3)
    return j.select(*listing.columns, status.alias("status"), prio.alias("priority"))


def attach_audience_awards(titles: DataFrame, audience: DataFrame, awards: DataFrame,
                           key="title_id") -> DataFrame:
    """C14: left join audience score and four award counts; counts default 0."""
    cols = ["oscar_wins", "oscar_noms", "gg_wins", "gg_noms"]
    out = titles.join(_one_row(audience, key).select(key, "audience_score"), key, "left") \
                .join(_one_row(awards, key).select(key, *cols), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def guide_live_over_cache(live: DataFrame, cached: DataFrame, cols=GUIDE_COLUMNS,
                          key="title_id") -> DataFrame:
    """Per title the fresh record if it has any value, else the cached
    one; the two are never mixed."""
    lv = _one_row(live, key).select(key, *[F.col(c).alias("_l_" + c) for c in cols])
    cv = _one_row(cached, key).select(key, *[F.col(c).alias("_c_" + c) for c in cols])
    j = lv.join(cv, key, "full")
    fresh = F.coalesce(*["_l_" + c for c in cols]).isNotNull()
    return j.select(key, *[F.when(fresh, F.col("_l_" + c)).otherwise(F.col("_c_" + c)).alias(c) for c in cols])


# ---------------------------------------------------------------- set operations

def union_titles(frames: list[DataFrame], key="title_id", source_col: str | None = None) -> DataFrame:
    """G1: union several title tables by name, one row per id, first source
    (then first ``_ord``) wins; ``source_col`` keeps the winning source index."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    u = tagged[0]
    for f in tagged[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    out = dedupe(u, key, ["_src", "_ord"], keep="first").drop("_ord")
    return out.withColumnRenamed("_src", source_col) if source_col else out.drop("_src")


def merge_keep_last(base: DataFrame, parts: list[DataFrame], key="title_id") -> DataFrame:
    """Base then parts in order; the last row per id wins."""
    frames = [base.withColumn("_src", F.lit(0))] + [p.withColumn("_src", F.lit(i + 1))
                                                   for i, p in enumerate(parts)]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return dedupe(u, key, ["_src", "_ord"], keep="last").drop("_src")


def upsert_non_blank(base: DataFrame, updates: DataFrame, value_col: str, key="title_id",
                     order: str | None = None) -> DataFrame:
    """Replace a base row only when the update's value is not blank.

    Output carries a ``rescued`` flag: the base value failed and the update's
    did not.  Of several good updates of a key the last by ``order`` wins
    (without it the greatest row).
    """
    cols = [c for c in base.columns if c != key]
    good = dedupe(updates.filter(is_ok(value_col)), key, order or cols, keep="last").select(key, *[F.col(c).alias("_u_" + c) for c in cols],
                                                   F.lit(True).alias("_has"))
    j = base.join(good, key, "full")
    use = F.col("_has").isNotNull()
    rescued = use & is_failed(value_col) if value_col in cols else F.lit(False)
    return j.select(key, *[F.when(use, F.col("_u_" + c)).otherwise(F.col(c)).alias(c) for c in cols],
                    F.coalesce(rescued, F.lit(False)).alias("rescued"))


def merge_catalog(old: DataFrame, new: DataFrame, current_ids: DataFrame | None = None,
                  keep_unlisted: bool = False, key="title_id") -> DataFrame:
    """G4 (+G5): old rows whose id is not in ``new``, plus the new rows.

    With ``keep_unlisted=False`` old rows whose id is in no current listing
    are dropped (G5), listed-but-not-refreshed rows are kept.
    """
    kept = old.join(new.select(key), key, "left_anti")
    if current_ids is not None and not keep_unlisted:
        kept = kept.join(current_ids.select(key).distinct(), key, "left_semi")
    return kept.unionByName(new, allowMissingColumns=True)


def removed_titles(cache: DataFrame, current_ids: DataFrame, key="title_id") -> DataFrame:
    """Ids in the cache that are in no current listing."""
    return cache.select(key).distinct().join(current_ids.select(key), key, "left_anti")


def append_if_absent(table: DataFrame, rows: DataFrame, key="title_id", order: str | None = None) -> DataFrame:
    """Append only rows whose id is new; of several rows of a new id the
    first by ``order`` (without it the least row)."""
    rows = dedupe(rows, key, order or [c for c in rows.columns if c != key], keep="first")
    if order and order not in table.columns:
        rows = rows.drop(order)
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def incremental_append_dedupe(done: DataFrame, new: DataFrame, key="title_id") -> DataFrame:
    """Done then new, first row per id wins."""
    u = done.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)),
                                                     allowMissingColumns=True)
    return dedupe(u, key, ["_src", "_ord"], keep="first").drop("_src")


def quota_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """at most ``n`` rows per group by order (e.g. titles per service)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def quota(df: DataFrame, order: list, n: int) -> DataFrame:
    """the first ``n`` pending rows by order (a daily budget)."""
    return df.orderBy(*order).limit(n)
