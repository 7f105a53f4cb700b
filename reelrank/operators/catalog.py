"""Catalog browsing jobs: seen flags, filters, sorts and pages.

The catalog is one row per title with one score and one seen flag per person
of interest.  Scores live in a long ``scores(user_id, title_id, pct)`` table;
``attach_people`` pivots the chosen people into columns with fixed pivot
values, so the pivot is a single aggregate with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import match_pct
from ..functions.nulls import all_of, any_of, dedupe


def first_service(listing: DataFrame, order=("service_rank", "l_orderkey", "l_linenumber")) -> DataFrame:
    """One service per title; the best-ranked service wins, then input order."""
    rows = listing.filter(F.col("title_id").isNotNull())
    return dedupe(rows.select("title_id", "service", *order), "title_id", list(order)) \
        .select("title_id", "service")


def person_scores(rated: DataFrame) -> DataFrame:
    """Long score table: mean rating of each person per title as a match %."""
    return (rated.groupBy("user_id", "title_id")
                 .agg(F.avg("rating").alias("_r"))
                 .select("user_id", "title_id", match_pct("_r").alias("pct")))


def seen_flags(df: DataFrame, seen: DataFrame, people: dict[str, str]) -> DataFrame:
    """Add one boolean column per person: has (person, title) been seen.

    ``people`` maps output column -> user_id.  The seen table is reduced to
    the chosen people and pivoted with fixed values before the join, so the
    join side is one row per title at most.
    """
    users = list(people.values())
    flags = (seen.filter(F.col("user_id").isin(users))
                 .groupBy("title_id")
                 .agg(*[F.max(F.when(F.col("user_id") == u, F.lit(True))).alias(c)
                        for c, u in people.items()]))
    out = df.join(flags, "title_id", "left")
    return out.select(*df.columns, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in people])


def attach_scores(df: DataFrame, scores: DataFrame, people: dict[str, str]) -> DataFrame:
    """Pivot the chosen people's scores into columns (null when unscored)."""
    users = list(people.values())
    wide = (scores.filter(F.col("user_id").isin(users))
                  .groupBy("title_id")
                  .agg(*[F.max(F.when(F.col("user_id") == u, F.col("pct"))).alias(c)
                         for c, u in people.items()]))
    return df.join(wide, "title_id", "left")


def build_catalog(base: DataFrame, services: DataFrame, scores: DataFrame, seen: DataFrame,
                  person_a: str, person_b: str) -> DataFrame:
    """Catalog rows for a pair of people: attributes, service, scores, seen flags."""
    df = base.join(services, "title_id", "inner")
    df = attach_scores(df, scores, {"a_pct": person_a, "b_pct": person_b})
    return seen_flags(df, seen, {"a_seen": person_a, "b_seen": person_b})


# ---------------------------------------------------------------- filters

def filter_catalog(df: DataFrame, services=None, types=None, min_score: float = 0.0,
                   years: tuple[int, int] | None = (1950, 2026),
                   always_apply_year: bool = True,
                   default_years: tuple[int, int] = (1950, 2026)) -> DataFrame:
    """B2: service IN, type IN, score not null and >= min, year in range.

    Desktop applies the year range always (so null years vanish); the web
    applies it only when it differs from the default range.
    """
    preds: list[Column] = []
    if services:
        preds.append(F.col("service").isin(list(services)))
    if types:
        preds.append(F.col("type").isin(list(types)))
    if min_score and min_score > 0:
        preds.append(F.col("imdb_score").isNotNull() & (F.col("imdb_score") >= min_score))
    if years is not None and (always_apply_year or tuple(years) != tuple(default_years)):
        preds.append(F.col("year").isNotNull() & F.col("year").between(years[0], years[1]))
    return df.filter(all_of(preds)) if preds else df


def filter_watched(df: DataFrame, conditions: list[tuple[str, bool]], mode: str = "or") -> DataFrame:
    """Keep rows matching seen/not-seen conditions, OR-ed (desktop) or AND-ed (web)."""
    if not conditions:
        return df
    preds = [F.col(c) if want else ~F.col(c) for c, want in conditions]
    return df.filter(any_of(preds) if mode == "or" else all_of(preds))


def filter_genre(df: DataFrame, genre: str, genres_col: str = "genres") -> DataFrame:
    """Exact membership of one genre in the genre array."""
    return df.filter(F.array_contains(F.col(genres_col), genre))


# ---------------------------------------------------------------- sort / page

def sort_keys(mode: str, profile: str = "desktop") -> list[Column]:
    """sort expressions, descending, nulls last; title id breaks ties.

    Desktop modes: compat, a, b, imdb, year.  Web modes (no compat): a, b,
    imdb, year on the rounded card values with null counted as 0.
    """
    if profile == "web":
        base = {"a": F.bround("a_pct", 0), "b": F.bround("b_pct", 0),
                "imdb": F.bround("imdb_score", 1), "year": F.col("year")}[mode]
        key = F.coalesce(base.cast("double"), F.lit(0.0))
        return [key.desc(), F.col("title_id").asc()]
    base = {"compat": (F.col("a_pct") + F.col("b_pct")) / 2, "a": F.col("a_pct"),
            "b": F.col("b_pct"), "imdb": F.col("imdb_score"), "year": F.col("year")}[mode]
    return [base.desc_nulls_last(), F.col("title_id").asc()]


def sort_catalog(df: DataFrame, mode: str, profile: str = "desktop") -> DataFrame:
    return df.orderBy(*sort_keys(mode, profile))


def page(df: DataFrame, mode: str, visible: int = 8, profile: str = "desktop",
         offset: int = 0) -> DataFrame:
    """the visible slice of the sorted catalog with its 1-based position.

    Sort + limit plans as TakeOrderedAndProject: each partition keeps its own
    top ``visible`` rows, so only ``partitions x visible`` rows ever meet.
    """
    keys = sort_keys(mode, profile)
    top = df.orderBy(*keys).limit(offset + visible)
    w = Window.orderBy(*keys)   # over at most offset + visible rows
    out = top.withColumn("pos", F.row_number().over(w))
    return out.filter(F.col("pos") > offset)


def remaining(df: DataFrame, visible: int) -> DataFrame:
    """how many rows are left after the visible ones (one row)."""
    return df.agg(F.greatest(F.count(F.lit(1)) - F.lit(visible), F.lit(0)).alias("remaining"))
