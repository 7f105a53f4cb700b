"""Ingest queries: A1, A2 (+H1-H9, H17, H18, H25), A6, A7, A8, B1, B9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import parse as P
from ..functions.nulls import is_ok
from ..sources import ingest as I
from . import views as V
from .oracle_views import with_views
from .registry import query

# ---------------------------------------------------------------- A1, B9


def raw_ratings(t):
    """Exported ratings with holes: no id on line 7, no rating on line 3."""
    r = V.rated(t)
    return r.select(
        "user_id",
        F.when(F.col("l_linenumber") == 7, None)
         .otherwise(F.concat(F.lit("tt"), F.lpad(F.col("title_id").cast("string"), 7, "0")))
         .alias("Const"),
        F.when(F.col("l_linenumber") == 3, None)
         .otherwise(F.col("rating").cast("bigint").cast("string")).alias("Your Rating"),
        F.concat(F.lit("Title "), F.col("title_id").cast("string")).alias("Title"),
        F.struct(*V.RATED_ORDER).alias("_ord"))


RAW_SQL = """
    SELECT user_id,
           CASE WHEN l_linenumber = 7 THEN NULL
                ELSE 'tt' || lpad(CAST(title_id AS VARCHAR), 7, '0') END AS Const,
           CASE WHEN l_linenumber = 3 THEN NULL
                ELSE CAST(CAST(rating AS BIGINT) AS VARCHAR) END AS your_rating,
           'Title ' || CAST(title_id AS VARCHAR) AS Title,
           l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM rated"""


@query("a1_ingest_ratings", with_views("""
    SELECT user_id, title_id, rating, title FROM (
      SELECT user_id, Const AS title_id, CAST(your_rating AS DOUBLE) AS rating, Title AS title,
             row_number() OVER (PARTITION BY user_id, Const
                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
      FROM raw WHERE Const IS NOT NULL AND your_rating IS NOT NULL) WHERE rn = 1""",
    "rated", extra={"raw": RAW_SQL}))
def a1_ingest_ratings(spark, sf_dir):
    return I.ingest_ratings(raw_ratings(V.Tables(spark, sf_dir)))


@query("b9_usable_ids", with_views("""
    SELECT DISTINCT Const AS title_id FROM raw
    WHERE Const IS NOT NULL AND trim(Const) <> ''""", "rated", extra={"raw": RAW_SQL}))
def b9_usable_ids(spark, sf_dir):
    raw = raw_ratings(V.Tables(spark, sf_dir))
    return raw.filter(is_ok("Const")).select(F.col("Const").alias("title_id")).distinct()


# ---------------------------------------------------------------- A2 metadata replies

def metadata_replies(t):
    """One JSON metadata reply per part, written as text by string concatenation."""
    p = t.part
    s, k = F.col("p_size"), F.col("p_partkey")
    y = (s * 2 + 1940)
    txt = lambda c: c.cast("string")
    ratings = (F.when(s % 3 == 0, F.concat(
                   F.lit(',"Ratings":[{"Source":"Internet Movie Database","Value":"7.1/10"},'
                         '{"Source":"Rotten Tomatoes","Value":"'), txt(s * 2), F.lit('%"}]')))
                .when(s % 3 == 1, F.lit(',"Ratings":[]'))
                .when(s % 11 == 0, F.lit(""))
                .otherwise(F.lit(',"Ratings":[{"Source":"Metacritic","Value":"50/100"}]')))
    reply = F.concat(
        F.lit('{"imdbID":"tt'), F.lpad(txt(k), 7, "0"),
        F.lit('","Title":"'), F.col("p_name"),
        F.lit('","Year":"'), txt(y), F.when(s % 5 == 0, F.concat(F.lit("–"), txt(y + 3))).otherwise(""),
        F.lit('","Rated":"'), F.when(s % 4 == 0, "PG-13").when(s % 4 == 1, "TV-MA")
                                .when(s % 4 == 2, "Not Rated").otherwise("R"),
        F.lit('","Runtime":"'), F.when(s % 9 == 0, "N/A").otherwise(F.concat(txt(s * 3), F.lit(" min"))),
        F.lit('","Genre":"'), F.col("p_type"), F.lit(', Drama'),
        F.lit('","Director":"Director '), txt(k % 50),
        F.lit('","Actors":"'), F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")),
        F.lit('","Language":"'), F.when(s % 3 == 0, "English, French").when(s % 3 == 1, "Hindi, English")
                                   .otherwise("Spanish"),
        F.lit('","Country":"'), F.when(s % 4 == 0, "United States, India").when(s % 4 == 1, "united kingdom")
                                  .when(s % 4 == 2, "France").otherwise("India"),
        F.lit('","Awards":"'), F.when(s % 3 == 0, F.concat(F.lit("Won "), txt(s % 4), F.lit(" Oscars. Another "),
                                                           txt(s), F.lit(" wins & "), txt(s * 4),
                                                           F.lit(" nominations.")))
                                .when(s % 3 == 1, F.concat(F.lit("Nominated for 1 Oscar. Another "), txt(s),
                                                           F.lit(" nominations.")))
                                .otherwise("N/A"),
        F.lit('","imdbRating":"'), F.when(s % 8 == 0, "N/A").otherwise(
            F.concat(txt(s % 9 + 1), F.lit("."), txt(k % 10))),
        F.lit('","imdbVotes":"'), F.format_number(k * 12345, 0),
        F.lit('","BoxOffice":"'), F.when(s % 6 == 0, "N/A").otherwise(
            F.concat(F.lit("$"), F.format_number(k * 98765, 0))),
        F.lit('","Type":"'), F.when(F.col("p_type") == "PROMO", "series").otherwise("movie"),
        F.lit('","Response":"'), F.when(s == 50, "False").otherwise("True"),
        F.lit('"'), ratings, F.lit("}"))
    return p.select(F.col("p_partkey").alias("title_id"), reply.alias("reply"))


REPLY_SQL = """
    SELECT p_partkey AS title_id,
      '{"imdbID":"tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') ||
      '","Title":"' || p_name ||
      '","Year":"' || CAST(p_size * 2 + 1940 AS VARCHAR) ||
          CASE WHEN p_size % 5 = 0 THEN '–' || CAST(p_size * 2 + 1943 AS VARCHAR) ELSE '' END ||
      '","Rated":"' || CASE p_size % 4 WHEN 0 THEN 'PG-13' WHEN 1 THEN 'TV-MA' WHEN 2 THEN 'Not Rated' ELSE 'R' END ||
      '","Runtime":"' || CASE WHEN p_size % 9 = 0 THEN 'N/A' ELSE CAST(p_size * 3 AS VARCHAR) || ' min' END ||
      '","Genre":"' || p_type || ', Drama' ||
      '","Director":"Director ' || CAST(p_partkey % 50 AS VARCHAR) ||
      '","Actors":"' || replace(p_name, ' ', ', ') ||
      '","Language":"' || CASE p_size % 3 WHEN 0 THEN 'English, French' WHEN 1 THEN 'Hindi, English' ELSE 'Spanish' END ||
      '","Country":"' || CASE p_size % 4 WHEN 0 THEN 'United States, India' WHEN 1 THEN 'united kingdom'
                                         WHEN 2 THEN 'France' ELSE 'India' END ||
      '","Awards":"' || CASE p_size % 3
            WHEN 0 THEN 'Won ' || CAST(p_size % 4 AS VARCHAR) || ' Oscars. Another ' || CAST(p_size AS VARCHAR)
                        || ' wins & ' || CAST(p_size * 4 AS VARCHAR) || ' nominations.'
            WHEN 1 THEN 'Nominated for 1 Oscar. Another ' || CAST(p_size AS VARCHAR) || ' nominations.'
            ELSE 'N/A' END ||
      '","imdbRating":"' || CASE WHEN p_size % 8 = 0 THEN 'N/A'
            ELSE CAST(p_size % 9 + 1 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) END ||
      '","imdbVotes":"' || format('{:,}', p_partkey * 12345) ||
      '","BoxOffice":"' || CASE WHEN p_size % 6 = 0 THEN 'N/A' ELSE '$' || format('{:,}', p_partkey * 98765) END ||
      '","Type":"' || CASE WHEN p_type = 'PROMO' THEN 'series' ELSE 'movie' END ||
      '","Response":"' || CASE WHEN p_size = 50 THEN 'False' ELSE 'True' END || '"' ||
      CASE WHEN p_size % 3 = 0 THEN ',"Ratings":[{"Source":"Internet Movie Database","Value":"7.1/10"},{"Source":"Rotten Tomatoes","Value":"'
                                   || CAST(p_size * 2 AS VARCHAR) || '%"}]'
           WHEN p_size % 3 = 1 THEN ',"Ratings":[]'
           WHEN p_size % 11 = 0 THEN ''
           ELSE ',"Ratings":[{"Source":"Metacritic","Value":"50/100"}]' END || '}' AS reply
    FROM part"""

FLAT_SQL = r"""
    SELECT title_id, j->>'imdbID' AS imdb_id, j->>'Title' AS title,
      TRY_CAST(replace(trim(j->>'Year'), '–', '') AS BIGINT) AS year_raw,
      coalesce(TRY_CAST(nullif(regexp_extract(coalesce(j->>'Year', ''), '(\d{4})', 1), '') AS INTEGER), 2000) AS year,
      j->>'Rated' AS rated,
      TRY_CAST(split_part(trim(j->>'Runtime'), ' ', 1) AS INTEGER) AS runtime,
      j->>'Genre' AS genre, j->>'Director' AS director, j->>'Actors' AS actors,
      j->>'Writer' AS writer, j->>'Plot' AS plot, j->>'Language' AS language,
      j->>'Country' AS country, j->>'Awards' AS awards,
      TRY_CAST(j->>'imdbRating' AS DOUBLE) AS imdb_rating,
      TRY_CAST(replace(j->>'imdbVotes', ',', '') AS BIGINT) AS imdb_votes,
      TRY_CAST(j->>'Metascore' AS DOUBLE) AS metascore,
      TRY_CAST(regexp_replace(j->>'BoxOffice', '[$,]', '', 'g') AS DOUBLE) AS box_office,
      TRY_CAST(replace(list_filter(from_json(j->'Ratings', '[{"Source":"VARCHAR","Value":"VARCHAR"}]'),
                                   lambda r: r.Source = 'Rotten Tomatoes')[1].Value, '%', '') AS DOUBLE) AS rt_score,
      j->>'Type' AS type,
      CASE WHEN lower(coalesce(j->>'Type', '')) SIMILAR TO '.*(series|episode|mini).*' THEN 'tv' ELSE 'movie' END AS content_type,
      j->>'Production' AS production,
      coalesce(list_sum(list_transform(regexp_extract_all(coalesce(j->>'Awards', ''), '(?i)(\d+)\s+win', 1),
                                       lambda x: CAST(x AS DOUBLE))), 0.0) AS award_wins,
      coalesce(list_sum(list_transform(regexp_extract_all(coalesce(j->>'Awards', ''), '(?i)(\d+)\s+nomination', 1),
                                       lambda x: CAST(x AS DOUBLE))), 0.0) AS award_noms,
      CASE WHEN regexp_matches(coalesce(j->>'Awards', ''), '(?i)\bwon\b.*\boscar') THEN 1.0 ELSE 0.0 END AS oscar_win,
      CASE WHEN regexp_matches(coalesce(j->>'Awards', ''), '(?i)\bnominat')
            AND regexp_matches(coalesce(j->>'Awards', ''), '(?i)\boscar') THEN 1.0 ELSE 0.0 END AS oscar_nom
    FROM (SELECT title_id, CAST(reply AS JSON) AS j FROM replies)
    WHERE coalesce(j->>'Response', 'True') <> 'False'"""


def flat(spark, sf_dir):
    return I.flatten_metadata(metadata_replies(V.Tables(spark, sf_dir)), keep=("title_id",))


@query("a2_flatten_metadata", with_views("SELECT * FROM flat", extra={"replies": REPLY_SQL, "flat": FLAT_SQL}))
def a2_flatten_metadata(spark, sf_dir):
    return flat(spark, sf_dir)


FLAGS_SQL = """
    SELECT title_id,
      CAST(floor(year / 10) * 10 < 1970 AS INTEGER) AS decade_pre1970s,
      CAST(floor(year / 10) * 10 = 1970 AS INTEGER) AS decade_1970s,
      CAST(floor(year / 10) * 10 = 1980 AS INTEGER) AS decade_1980s,
      CAST(floor(year / 10) * 10 = 1990 AS INTEGER) AS decade_1990s,
      CAST(floor(year / 10) * 10 = 2000 AS INTEGER) AS decade_2000s,
      CAST(floor(year / 10) * 10 = 2010 AS INTEGER) AS decade_2010s,
      CAST(floor(year / 10) * 10 >= 2020 AS INTEGER) AS decade_2020s,
      CAST(rb = 'G' AS INTEGER) AS rated_G, CAST(rb = 'PG' AS INTEGER) AS rated_PG,
      CAST(rb = 'PG13' AS INTEGER) AS rated_PG13, CAST(rb = 'R' AS INTEGER) AS rated_R,
      CAST(rb = 'NR' AS INTEGER) AS rated_NR,
      CAST(pl = 'English' AS INTEGER) AS lang_english, CAST(pl = 'Hindi' AS INTEGER) AS lang_hindi,
      CAST(pl NOT IN ('English', 'Hindi') AS INTEGER) AS lang_other,
      CAST(contains(lc, 'united states') AS INTEGER) AS country_us,
      CAST(contains(lc, 'united kingdom') AS INTEGER) AS country_uk,
      CAST(contains(lc, 'india') AS INTEGER) AS country_india,
      CAST(NOT (contains(lc, 'united states') OR contains(lc, 'united kingdom') OR contains(lc, 'india')) AS INTEGER) AS country_other,
      CASE WHEN runtime IS NULL THEN 'N/A' WHEN runtime // 60 > 0 THEN printf('%dh %dm', runtime // 60, runtime % 60)
           ELSE printf('%dm', runtime % 60) END AS runtime_text,
      CASE WHEN ow <> 0 THEN CAST(ow AS VARCHAR) || ' Oscar' || CASE WHEN ow <> 1 THEN 's' ELSE '' END
                  || CASE WHEN onm <> 0 THEN ' / ' || CAST(onm AS VARCHAR) || ' nom' || CASE WHEN onm <> 1 THEN 's' ELSE '' END ELSE '' END
           WHEN onm <> 0 THEN CAST(onm AS VARCHAR) || ' Oscar nom' || CASE WHEN onm <> 1 THEN 's' ELSE '' END
           WHEN aw <> 0 THEN CAST(aw AS VARCHAR) || ' win' || CASE WHEN aw <> 1 THEN 's' ELSE '' END
                  || CASE WHEN an <> 0 THEN ' / ' || CAST(an AS VARCHAR) || ' nom' || CASE WHEN an <> 1 THEN 's' ELSE '' END ELSE '' END
           WHEN an <> 0 THEN CAST(an AS VARCHAR) || ' nomination' || CASE WHEN an <> 1 THEN 's' ELSE '' END
      END AS award_text,
      len(list_filter(list_transform(string_split(coalesce(genre, ''), ','), lambda x: trim(x)),
                      lambda x: x NOT IN ('', 'N/A', 'Unknown'))) AS n_genres
    FROM (SELECT *,
            coalesce(CASE rated WHEN 'R' THEN 'R' WHEN 'TV-MA' THEN 'R' WHEN '18+' THEN 'R'
                          WHEN 'PG-13' THEN 'PG13' WHEN 'TV-14' THEN 'PG13' WHEN '16+' THEN 'PG13'
                          WHEN 'PG' THEN 'PG' WHEN 'TV-PG' THEN 'PG' WHEN 'G' THEN 'G' WHEN 'TV-G' THEN 'G' END, 'NR') AS rb,
            coalesce(nullif(trim(split_part(coalesce(language, ''), ',', 1)), ''), '') AS pl,
            lower(coalesce(country, '')) AS lc,
            CAST(coalesce(oscar_win, 0) AS INTEGER) AS ow, CAST(coalesce(oscar_nom, 0) AS INTEGER) AS onm,
            CAST(coalesce(award_wins, 0) AS INTEGER) AS aw, CAST(coalesce(award_noms, 0) AS INTEGER) AS an
          FROM flat)"""


@query("h_feature_flags", with_views(FLAGS_SQL, extra={"replies": REPLY_SQL, "flat": FLAT_SQL}))
def h_feature_flags(spark, sf_dir):
    """H6-H10, H17, H18 on the flattened replies."""
    df = flat(spark, sf_dir)
    cols = {**P.decade_columns("year"), **P.rated_columns("rated"),
            **P.language_columns("language"), **P.country_columns("country")}
    return df.select("title_id", *[v.alias(k) for k, v in cols.items()],
                     D.runtime_text("runtime").alias("runtime_text"),
                     D.award_text("oscar_win", "oscar_nom", "award_wins", "award_noms").alias("award_text"),
                     F.size(P.genre_list("genre")).alias("n_genres"))


# ---------------------------------------------------------------- A6, A7, A8

@query("a6_score_map", """
    SELECT e.event_id, j.key AS key, CAST(j.value AS INTEGER) AS score
    FROM events e, json_each(e.props) j""")
def a6_score_map(spark, sf_dir):
    ev = V.Tables(spark, sf_dir).events
    return I.explode_score_map(ev, "props", keep=("event_id",))


@query("a7_page_entities", r"""
    SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
           regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
           len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links
    FROM pages""")
def a7_page_entities(spark, sf_dir):
    pages = V.Tables(spark, sf_dir).pages
    return I.extract_page_entities(pages).select("page_id", "title", "lang",
                                                 F.col("n_links").cast("bigint").alias("n_links"))


A8_PATTERN = r"https?://[^/\s\"]+/[a-z]{2}/(\d+)"


@query("a8_extract_ids", r"""
    SELECT DISTINCT regexp_extract(cell, 'https?://[^/\s"]+/[a-z]{2}/(\d+)', 1) AS id
    FROM (SELECT unnest([url, html]) AS cell FROM pages)
    WHERE contains(cell, 'example.')
      AND regexp_extract(cell, 'https?://[^/\s"]+/[a-z]{2}/(\d+)', 1) <> ''""")
def a8_extract_ids(spark, sf_dir):
    pages = V.Tables(spark, sf_dir).pages
    return I.extract_ids(pages, ["url", "html"], A8_PATTERN, must_contain="example.")


# ---------------------------------------------------------------- B1

@query("b1_clean_training_rows", with_views("""
    SELECT h.user_id, h.title_id, h.rating, d.n_chars AS plot_chars,
           coalesce(h.director, 'Unknown') AS director, coalesce(h.actors, 'Unknown') AS actors,
           coalesce(h.studio, 'Unknown') AS studio, coalesce(h.genre, 'Unknown') AS genre,
           coalesce(d.lang, 'Unknown') AS language, coalesce(d.source, 'Unknown') AS source,
           coalesce(CAST(NULL AS VARCHAR), 'Unknown') AS writer
    FROM history_full h LEFT JOIN documents d ON h.title_id = d.doc_id
    WHERE h.rating IS NOT NULL AND d.text IS NOT NULL AND trim(d.text) <> 'N/A'""",
    "history_full", "title_info"))
def b1_clean_training_rows(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    docs = t.documents.select(F.col("doc_id").alias("title_id"), F.col("text").alias("plot"),
                              F.col("lang").alias("language"), "source", "n_chars")
    df = V.history_full(t).join(docs, "title_id", "left").withColumn("writer", F.lit(None).cast("string"))
    from ..plans.features import clean_training_rows
    out = clean_training_rows(df)
    return out.select("user_id", "title_id", "rating", F.col("n_chars").alias("plot_chars"),
                      "director", "actors", "studio", "genre", "language", "source", "writer")
