"""Catalog browse queries: E7, C7, B2-B5, F1, F2 (the minimum slice)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.display import confidence, runtime_text
from ..functions.parse import genre_list
from ..operators import catalog as cat
from ..operators.rank_index import read_page, write_rank_index
from ..session import ensure_checkpoint_dir
from . import views as V
from .oracle_views import with_views
from .registry import query

A, B = V.PERSON_A, V.PERSON_B

# ---------------------------------------------------------------- shared plans


def catalog(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    services = cat.first_service(V.listing(t))
    scores = cat.person_scores(V.rated(t))
    return cat.build_catalog(V.catalog_base(t), services, scores, V.seen(t), A, B)


CATALOG_CTES = {
    "services": """
        SELECT title_id, service FROM (
          SELECT title_id, service, row_number() OVER (PARTITION BY title_id
                 ORDER BY service_rank, l_orderkey, l_linenumber) AS rn
          FROM listing WHERE title_id IS NOT NULL) WHERE rn = 1""",
    "scores": """
        SELECT user_id, title_id,
               round_even(least(greatest(avg(rating), 1.0), 10.0) * 10, 1) AS pct
        FROM rated GROUP BY user_id, title_id""",
    "catalog": f"""
        SELECT b.*, s.service,
               (SELECT pct FROM scores x WHERE x.title_id = b.title_id AND x.user_id = '{A}') AS a_pct,
               (SELECT pct FROM scores x WHERE x.title_id = b.title_id AND x.user_id = '{B}') AS b_pct,
               EXISTS (SELECT 1 FROM seen x WHERE x.title_id = b.title_id AND x.user_id = '{A}') AS a_seen,
               EXISTS (SELECT 1 FROM seen x WHERE x.title_id = b.title_id AND x.user_id = '{B}') AS b_seen
        FROM catalog_base b JOIN services s ON b.title_id = s.title_id""",
}


def catalog_sql(sql: str) -> str:
    return with_views(sql, "rated", "seen", "listing", "catalog_base", extra=CATALOG_CTES)


# ---------------------------------------------------------------- E7, C7

@query("e7_first_service", catalog_sql("SELECT title_id, service FROM services"))
def e7_first_service(spark, sf_dir):
    return cat.first_service(V.listing(V.Tables(spark, sf_dir)))


@query("c7_seen_flags", catalog_sql("SELECT title_id, a_seen, b_seen FROM catalog"))
def c7_seen_flags(spark, sf_dir):
    return catalog(spark, sf_dir).select("title_id", "a_seen", "b_seen")


@query("d1_person_scores", catalog_sql("SELECT user_id, title_id, pct FROM scores"))
def d1_person_scores(spark, sf_dir):
    return cat.person_scores(V.rated(V.Tables(spark, sf_dir)))


# ---------------------------------------------------------------- B2, B3, B4

COLS = "title_id, service, type, imdb_score, year, a_pct, b_pct, a_seen, b_seen"


@query("b2_filter_catalog_desktop", catalog_sql(f"""
    SELECT {COLS} FROM catalog
    WHERE service IN ('AMERICA', 'ASIA', 'EUROPE') AND type IN ('movie')
      AND imdb_score IS NOT NULL AND imdb_score >= 6.0
      AND year IS NOT NULL AND year BETWEEN 1950 AND 2026"""))
def b2_filter_catalog_desktop(spark, sf_dir):
    df = cat.filter_catalog(catalog(spark, sf_dir), services=["AMERICA", "ASIA", "EUROPE"],
                            types=["movie"], min_score=6.0, years=(1950, 2026),
                            always_apply_year=True)
    return df.select(*COLS.split(", "))


@query("b2_filter_catalog_web", catalog_sql(f"""
    SELECT {COLS} FROM catalog
    WHERE type IN ('tv') AND imdb_score IS NOT NULL AND imdb_score >= 3.0"""))
def b2_filter_catalog_web(spark, sf_dir):
    df = cat.filter_catalog(catalog(spark, sf_dir), types=["tv"], min_score=3.0,
                            years=(1950, 2026), always_apply_year=False)
    return df.select(*COLS.split(", "))


@query("b3_filter_watched_or", catalog_sql(
    f"SELECT {COLS} FROM catalog WHERE (NOT a_seen) OR b_seen"))
def b3_filter_watched_or(spark, sf_dir):
    df = cat.filter_watched(catalog(spark, sf_dir), [("a_seen", False), ("b_seen", True)], "or")
    return df.select(*COLS.split(", "))


@query("b3_filter_watched_and", catalog_sql(
    f"SELECT {COLS} FROM catalog WHERE (NOT a_seen) AND (NOT b_seen)"))
def b3_filter_watched_and(spark, sf_dir):
    df = cat.filter_watched(catalog(spark, sf_dir), [("a_seen", False), ("b_seen", False)], "and")
    return df.select(*COLS.split(", "))


# ---------------------------------------------------------------- B5 cards, B4

CARD_SQL = """
    SELECT title_id AS id, title, year,
           list_filter(list_transform(string_split(coalesce(genre, ''), ','), lambda x: trim(x)),
                       lambda x: x NOT IN ('', 'N/A', 'Unknown')) AS genres,
           CASE WHEN runtime IS NULL THEN 'N/A'
                WHEN runtime // 60 > 0 THEN printf('%dh %dm', runtime // 60, runtime % 60)
                ELSE printf('%dm', runtime % 60) END AS runtime_text,
           CAST(round_even(a_pct, 0) AS INTEGER) AS a_score,
           CAST(round_even(b_pct, 0) AS INTEGER) AS b_score,
           round_even(imdb_score, 1) AS imdb,
           service, type, a_seen, b_seen,
           CASE WHEN round_even(a_pct, 0) >= 90 THEN 'Top Pick'
                WHEN round_even(a_pct, 0) >= 80 THEN 'Strong Contender'
                WHEN round_even(a_pct, 0) >= 70 THEN 'Likely Enjoy'
                ELSE 'Mixed Signals' END AS a_confidence,
           CASE WHEN round_even(b_pct, 0) >= 90 THEN 'Top Pick'
                WHEN round_even(b_pct, 0) >= 80 THEN 'Strong Contender'
                WHEN round_even(b_pct, 0) >= 70 THEN 'Likely Enjoy'
                ELSE 'Mixed Signals' END AS b_confidence
    FROM catalog"""


def cards(df):
    """The 14-column card (+ confidence bands, H19)."""
    a_score = F.bround("a_pct", 0).cast("int")
    b_score = F.bround("b_pct", 0).cast("int")
    return df.select(
        F.col("title_id").alias("id"), "title", "year",
        genre_list("genre").alias("genres"),
        runtime_text("runtime").alias("runtime_text"),
        a_score.alias("a_score"), b_score.alias("b_score"),
        F.bround("imdb_score", 1).alias("imdb"),
        "service", "type", "a_seen", "b_seen",
        F.coalesce(confidence(a_score), F.lit("Mixed Signals")).alias("a_confidence"),
        F.coalesce(confidence(b_score), F.lit("Mixed Signals")).alias("b_confidence"))


@query("b5_catalog_cards", catalog_sql(CARD_SQL))
def b5_catalog_cards(spark, sf_dir):
    return cards(catalog(spark, sf_dir))


@query("b4_filter_genre", catalog_sql(
    f"SELECT * FROM ({CARD_SQL}) WHERE list_contains(genres, 'MEDIUM')"))
def b4_filter_genre(spark, sf_dir):
    return cat.filter_genre(cards(catalog(spark, sf_dir)), "MEDIUM")


# ---------------------------------------------------------------- F1, F2

def _page_sql(order: str, n: int, offset: int = 0, where: str = "TRUE") -> str:
    return catalog_sql(f"""
        SELECT title_id, a_pct, b_pct, imdb_score, year,
               CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS pos
        FROM catalog WHERE {where}
        ORDER BY {order} LIMIT {n} OFFSET {offset}""")


def _page(spark, sf_dir, mode, n, offset=0, profile="desktop", seen_filter=None):
    df = catalog(spark, sf_dir)
    if seen_filter:
        df = cat.filter_watched(df, seen_filter, "and")
    out = cat.page(df, mode, n, profile, offset)
    return out.select("title_id", "a_pct", "b_pct", "imdb_score", "year",
                      F.col("pos").cast("int").alias("pos"))


@query("f1_page_compat", _page_sql("(a_pct + b_pct) / 2 DESC NULLS LAST, title_id", 8))
def f1_page_compat(spark, sf_dir):
    return _page(spark, sf_dir, "compat", 8)


@query("f1_page_imdb_second", _page_sql("imdb_score DESC NULLS LAST, title_id", 16, 8))
def f1_page_imdb_second(spark, sf_dir):
    return _page(spark, sf_dir, "imdb", 16, offset=8)


@query("f1_page_year", _page_sql("year DESC NULLS LAST, title_id", 8))
def f1_page_year(spark, sf_dir):
    return _page(spark, sf_dir, "year", 8)


@query("f2_page_web_b", _page_sql(
    "coalesce(CAST(round_even(b_pct, 0) AS DOUBLE), 0.0) DESC, title_id", 12))
def f2_page_web_b(spark, sf_dir):
    return _page(spark, sf_dir, "b", 12, profile="web")


@query("f2_unseen_best_for_a", _page_sql(
    "a_pct DESC NULLS LAST, title_id", 8, where="NOT a_seen"))
def f2_unseen_best_for_a(spark, sf_dir):
    return _page(spark, sf_dir, "a", 8, seen_filter=[("a_seen", False)])


DEEP = 8 + 16 * 6          # the desktop's first page and six more


@query("f2_deep_page", _page_sql("(a_pct + b_pct) / 2 DESC NULLS LAST, title_id", 16, DEEP))
def f2_deep_page(spark, sf_dir):
    """A page far down, from the rank index of the whole catalog."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rank-{uuid.uuid4().hex}"
    columns = ["title_id", "a_pct", "b_pct", "imdb_score", "year"]
    order = cat.sort_keys("compat")
    write_rank_index(catalog(spark, sf_dir).select(*columns), order, path)
    return read_page(spark, path, order, 16, DEEP).select(*columns, F.col("pos").cast("int").alias("pos"))


@query("f2_remaining_count", catalog_sql(
    "SELECT CAST(greatest(count(*) - 8, 0) AS BIGINT) AS remaining FROM catalog WHERE type = 'movie'"))
def f2_remaining_count(spark, sf_dir):
    return cat.remaining(catalog(spark, sf_dir).filter(F.col("type") == "movie"), 8)
