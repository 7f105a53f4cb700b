"""Whole cards and details (B5, B6), verdicts (H19), primary entities with the
preferred cast list (H12) and genre flags by content (H10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.display import award_text, verdict
from ..functions.nulls import split_list
from ..operators import encode as enc
from . import views as V
from .oracle_views import with_views
from .q_catalog import CARD_SQL, CATALOG_CTES, cards, catalog
from .q_ingest import FLAGS_SQL, FLAT_SQL, REPLY_SQL, flat
from .q_merge import CAST_SQL, G5, GUIDE_SQL, ORD_CASE, cast_studio, guide
from .registry import query

POSTERS_SQL = "SELECT page_id AS id, min(url) AS poster FROM pages GROUP BY page_id"


def _sql(sql, **extra):
    return with_views(sql, "rated", "seen", "listing", "catalog_base", "title_info", extra={
        **CATALOG_CTES, "replies": REPLY_SQL, "flat": FLAT_SQL, "cards": CARD_SQL, "posters": POSTERS_SQL, **extra})


def _posters(t):
    """Stand-in posters: the address of the title's landed page."""
    return t.pages.groupBy(F.col("page_id").alias("id")).agg(F.min("url").alias("poster"))


def full_cards(base, metadata, posters):
    """The card with content rating (``N/A``) and poster (empty) in place of nulls.

    Side tables hold a row a title: their small files unfold to many times
    their size, so they are never broadcast (``merge``)."""
    rated = metadata.select(F.col("title_id").alias("id"), "rated")
    return (cards(base).join(rated.hint("merge"), "id", "left").join(posters.hint("merge"), "id", "left")
            .withColumns({"rating": F.coalesce("rated", F.lit("N/A")), "poster": F.coalesce("poster", F.lit(""))}).drop("rated"))


FULL_CARD = """SELECT k.*, coalesce(f.rated, 'N/A') AS rating, coalesce(p.poster, '') AS poster
    FROM cards k LEFT JOIN flat f ON f.title_id = k.id LEFT JOIN posters p ON p.id = k.id"""


@query("b5_full_cards", _sql(FULL_CARD))
def b5_full_cards(spark, sf_dir):
    return full_cards(catalog(spark, sf_dir), flat(spark, sf_dir), _posters(V.Tables(spark, sf_dir)))


def full_details(base, metadata, posters, guides):
    """The card, and synopsis, director, cast, critic scores, award text
    and the five guide levels (missing: 0) beside it."""
    more = metadata.select(
        F.col("title_id").alias("id"), F.coalesce("plot", F.lit("")).alias("synopsis"),
        F.coalesce("director", F.lit("N/A")).alias("director"), split_list("actors").alias("cast_list"),
        F.col("rt_score").cast("int").alias("rt_int"), F.col("metascore").cast("int").alias("meta_int"),
        award_text("oscar_win", "oscar_nom", "award_wins", "award_noms").alias("awards"))
    levels = guides.withColumnRenamed("title_id", "id")
    out = (full_cards(base, metadata, posters).join(more.hint("merge"), "id", "left")
           .join(levels.select("id", *G5).hint("merge"), "id", "left"))
    return out.withColumns({
        "synopsis": F.coalesce("synopsis", F.lit("")), "director": F.coalesce("director", F.lit("N/A")),
        "cast_list": F.coalesce("cast_list", F.array().cast("array<string>")),
        **{c: P.severity_ordinal(F.col(c), 0) for c in G5}})


@query("b6_full_details", _sql(f"""
    SELECT c.*, coalesce(f.plot, '') AS synopsis, coalesce(f.director, 'N/A') AS director,
           list_filter(list_transform(string_split(coalesce(f.actors, ''), ','), lambda x: trim(x)),
                       lambda x: x NOT IN ('', 'N/A')) AS cast_list,
           CAST(f.rt_score AS INTEGER) AS rt_int, CAST(f.metascore AS INTEGER) AS meta_int, w.award_text AS awards,
           {", ".join(f"coalesce({ORD_CASE.format(c='g.' + c)}, 0) AS {c}" for c in G5)}
    FROM full_card c LEFT JOIN flat f ON f.title_id = c.id LEFT JOIN flags w ON w.title_id = c.id
    LEFT JOIN guide g ON g.title_id = c.id""", full_card=FULL_CARD, flags=FLAGS_SQL, guide=GUIDE_SQL))
def b6_full_details(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    return full_details(catalog(spark, sf_dir), flat(spark, sf_dir), _posters(t), guide(t))


@query("h19_verdicts", _sql("""
    SELECT title_id, user_id, CASE WHEN pct >= 90 THEN 'Must Watch' WHEN pct >= 70 THEN 'Strong Contender'
                                   WHEN pct >= 50 THEN 'Coin Toss' ELSE 'Probably Not For You' END AS verdict FROM scores"""))
def h19_verdicts(spark, sf_dir):
    """The second scale of H19 on everyone's scores."""
    from ..operators.catalog import person_scores
    return person_scores(V.rated(V.Tables(spark, sf_dir))).select("title_id", "user_id", verdict("pct").alias("verdict"))


@query("h12_primary_entities", with_views("""
    SELECT t.title_id, nullif(trim(split_part(coalesce(t.director, ''), ',', 1)), '') AS director,
           coalesce(nullif(trim(split_part(coalesce(c.actors_rt, ''), ',', 1)), ''),
                    nullif(trim(split_part(coalesce(t.actors, ''), ',', 1)), '')) AS actor1,
           coalesce(CASE WHEN trim(t.studio) IN ('', 'N/A') THEN NULL ELSE trim(t.studio) END, 'Unknown') AS studio
    FROM title_info t LEFT JOIN cs c ON c.title_id = t.title_id""", "title_info", extra={"cs": CAST_SQL}))
def h12_primary_entities(spark, sf_dir):
    """First director, first actor of the preferred cast list (else of the
    title's), studio."""
    t = V.Tables(spark, sf_dir)
    rows = V.title_info(t).join(cast_studio(t).select("title_id", "actors_rt"), "title_id", "left")
    return enc.with_entities(rows, "actors_rt").select(
        "title_id", *(F.col("_" + k).alias(k) for k in enc.KINDS))


@query("h10_genre_flags", _sql("""
    SELECT t.title_id, string_agg(CASE WHEN list_contains(t.g, v.genre) THEN '1' ELSE '0' END, '' ORDER BY v.genre) AS flags
    FROM items t, (SELECT DISTINCT unnest(g) AS genre FROM items) v GROUP BY t.title_id""",
    items="""SELECT title_id, list_filter(list_transform(string_split(coalesce(genre, ''), ','), lambda x: trim(x)),
                                          lambda x: x NOT IN ('', 'N/A', 'Unknown')) AS g FROM title_info"""))
def h10_genre_flags(spark, sf_dir):
    """Each title's flags over the sorted vocabulary, as the model takes them."""
    from .model import genre_flags
    rows = V.title_info(V.Tables(spark, sf_dir)).select("title_id", P.genre_list("genre").alias("genres"))
    vocabulary = [r[0] for r in rows.select(F.explode("genres").alias("g")).distinct().orderBy("g").collect()]
    return rows.select("title_id", F.array_join(F.transform(genre_flags(vocabulary), lambda x: x.cast("int").cast("string")), "")
                       .alias("flags"))
