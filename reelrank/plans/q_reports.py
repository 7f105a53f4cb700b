"""Report queries: D5, D6, D7, D11, D12, D13, E5, E6, F3, H13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import aggregates as agg
from ..operators import prefs
from ..operators.split import stratified_split
from ..sources import ingest as I
from . import views as V
from .oracle_views import with_views
from .q_features import people_titles
from .q_ingest import FLAT_SQL, REPLY_SQL, flat
from .q_merge import CAST_SQL, TAG_CTES, cast_studio, tags_long
from .registry import query

A, B = V.PERSON_A, V.PERSON_B


def tag_rows(t):
    """Distinct (title, tag): title = event user, tag = event type + k mod 10."""
    ev = t.events
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(F.col("user_id").alias("title_id"),
                     F.concat(F.col("event_type"), F.lit("_"), (k % 10).cast("string")).alias("tag")).distinct()


TAG_ROWS_SQL = """SELECT DISTINCT user_id AS title_id,
                     event_type || '_' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS tag
                  FROM events"""

FREQ_SQL = """SELECT tag, count(*) AS n_titles,
                     count(*) / (SELECT count(DISTINCT title_id) FROM tag_rows) AS freq
              FROM tag_rows GROUP BY tag"""


@query("d5_tag_frequency", with_views("SELECT tag, n_titles, freq FROM freq",
                                      extra={"tag_rows": TAG_ROWS_SQL, "freq": FREQ_SQL}))
def d5_tag_frequency(spark, sf_dir):
    return agg.tag_frequency(tag_rows(V.Tables(spark, sf_dir)))


@query("f3_top_tags", with_views("""
    SELECT tag, n_titles FROM freq ORDER BY n_titles DESC, tag LIMIT 10""",
    extra={"tag_rows": TAG_ROWS_SQL, "freq": FREQ_SQL}))
def f3_top_tags(spark, sf_dir):
    f = agg.tag_frequency(tag_rows(V.Tables(spark, sf_dir)))
    return f.orderBy(F.col("n_titles").desc(), "tag").limit(10).select("tag", "n_titles")


@query("d6_tag_cooccurrence", with_views("""
    , cands AS (SELECT tag FROM freq WHERE freq BETWEEN 0.10 AND 0.80
                ORDER BY n_titles DESC, tag LIMIT 10),
    ct AS (SELECT r.title_id, r.tag FROM tag_rows r JOIN cands c ON r.tag = c.tag),
    pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS support
              FROM ct a JOIN ct b ON a.title_id = b.title_id AND a.tag < b.tag GROUP BY ALL),
    kept AS (SELECT tag_a AS tag FROM pairs WHERE support >= 25
             UNION SELECT tag_b FROM pairs WHERE support >= 25)
    SELECT ka.tag AS tag_a, kb.tag AS tag_b, coalesce(p.support, 0) AS support,
           'ix__' || ka.tag || '__' || kb.tag AS feature
    FROM kept ka JOIN kept kb ON ka.tag < kb.tag
    LEFT JOIN pairs p ON p.tag_a = ka.tag AND p.tag_b = kb.tag""",
    extra={"tag_rows": TAG_ROWS_SQL, "freq": FREQ_SQL}))
def d6_tag_cooccurrence(spark, sf_dir):
    return agg.tag_cooccurrence(tag_rows(V.Tables(spark, sf_dir)))


@query("d11_coverage_report", with_views("""
    SELECT studio AS source, count(*) AS rows,
           count(*) FILTER (WHERE actors_rt IS NOT NULL AND trim(actors_rt) <> '') AS ok,
           count(*) FILTER (WHERE actors_rt IS NULL OR trim(actors_rt) = '') AS failed,
           round_even(count(*) FILTER (WHERE actors_rt IS NOT NULL AND trim(actors_rt) <> '') * 100.0 / count(*), 1) AS pct_ok
    FROM cast_studio GROUP BY studio""", extra={"cast_studio": CAST_SQL}))
def d11_coverage_report(spark, sf_dir):
    cs = cast_studio(V.Tables(spark, sf_dir)).withColumnRenamed("studio", "source")
    out = agg.coverage_report(cs, "actors_rt", by="source")
    return out.withColumn("pct_ok", F.col("pct_ok").cast("double"))


@query("d12_genre_vocabulary", with_views("""
    SELECT DISTINCT trim(g) AS genre FROM (SELECT unnest(string_split(genre, ',')) AS g FROM flat)
    WHERE trim(g) NOT IN ('', 'N/A', 'Unknown')""", extra={"replies": REPLY_SQL, "flat": FLAT_SQL}))
def d12_genre_vocabulary(spark, sf_dir):
    return agg.genre_vocabulary(flat(spark, sf_dir))


@query("d13_catalog_freshness", """
    SELECT max(o_orderdate) AS newest,
           CAST(date_diff('day', CAST(max(o_orderdate) AS DATE),
                          CAST((SELECT max(l_shipdate) FROM lineitem) AS DATE)) AS INTEGER) AS age_days,
           max(o_orderdate) IS NULL OR date_diff('day', CAST(max(o_orderdate) AS DATE),
                          CAST((SELECT max(l_shipdate) FROM lineitem) AS DATE)) > 7 AS needs_refresh
    FROM orders""")
def d13_catalog_freshness(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    now = t.lineitem.agg(F.max("l_shipdate").alias("now"))
    return agg.catalog_freshness(t.orders, "o_orderdate", now)


@query("e5_argmax_per_key", with_views("""
    SELECT user_id, director, title_id, rating FROM (
      SELECT user_id, director, title_id, rating,
             row_number() OVER (PARTITION BY user_id, director ORDER BY rating DESC, title_id) AS rn
      FROM history_full) WHERE rn = 1""", "history_full", "title_info"))
def e5_argmax_per_key(spark, sf_dir):
    h = V.history_full(V.Tables(spark, sf_dir))
    best = h.groupBy("user_id", "director").agg(
        F.max_by(F.struct("title_id", "rating"), F.struct(F.col("rating"), -F.col("title_id"))).alias("b"))
    return best.select("user_id", "director", "b.title_id", "b.rating")


@query("e6_stratified_split", with_views("""
    SELECT user_id, title_id, rating, bin, COALESCE(rn <= round(n * 0.2), false) AS is_test FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, bin ORDER BY md5(CAST(title_id AS VARCHAR) || ':42'), title_id) AS rn,
                count(*) OVER (PARTITION BY user_id, bin) AS n
      FROM (SELECT user_id, title_id, rating,
                   CASE WHEN rating > 0 AND rating <= 3 THEN 0 WHEN rating > 3 AND rating <= 5 THEN 1
                        WHEN rating > 5 AND rating <= 7 THEN 2 WHEN rating > 7 AND rating <= 8 THEN 3
                        WHEN rating > 8 AND rating <= 10 THEN 4 END AS bin
            FROM history))""", "history"))
def e6_stratified_split(spark, sf_dir):
    h = V.history(V.Tables(spark, sf_dir), "rating")
    return stratified_split(h).select("user_id", "title_id", "rating", "bin", "is_test")


@query("h13_enriched_text", with_views("""
    SELECT title_id, CASE WHEN body = '' THEN coalesce(title, '') ELSE body END AS text FROM (
      SELECT title_id, title, concat_ws(' ',
        CASE WHEN trim(coalesce(director, '')) <> '' AND trim(coalesce(director, '')) NOT IN ('N/A', 'Unknown')
             THEN 'Director: ' || trim(director) || '.' END,
        CASE WHEN trim(coalesce(actors, '')) <> '' AND trim(coalesce(actors, '')) NOT IN ('N/A', 'Unknown')
             THEN 'Cast: ' || trim(actors) || '.' END,
        CASE WHEN trim(coalesce(writer, '')) <> '' AND trim(coalesce(writer, '')) NOT IN ('N/A', 'Unknown')
             THEN 'Writer: ' || trim(writer) || '.' END,
        CASE WHEN trim(coalesce(plot, '')) <> '' AND trim(coalesce(plot, '')) <> 'N/A' THEN trim(plot) END) AS body
      FROM flat)""", extra={"replies": REPLY_SQL, "flat": FLAT_SQL}))
def h13_enriched_text(spark, sf_dir):
    f = flat(spark, sf_dir)
    return f.select("title_id", P.enriched_text("director", "actors", "writer", "plot", "title").alias("text"))


# ---------------------------------------------------------------- D7


def _tag_keys(spark, t):
    tax = I.taxonomy(spark)
    tl = tags_long(spark, t).join(tax, ["category", "value"])
    return tl.select("title_id", P.tag_column_name("category", "value").alias("tag"), "pos")


def _d7_sql():
    extra, sql = d7_parts()
    return with_views(sql, "history_full", "title_info", extra=extra)


def d7_parts():
    from ..functions.fixed import TAG_TAXONOMY
    rows = [(c, v) for c, vs in TAG_TAXONOMY.items() for v in vs]
    tax = "SELECT * FROM (VALUES " + ", ".join(
        f"('{c}', '{v.replace(chr(39), chr(39) * 2)}', {i})" for i, (c, v) in enumerate(rows)) + ") t(category, value, pos)"
    safe = ("'tag_' || x.category || '_' || replace(replace(replace(replace(x.value, '&', 'and'), '/', '_'), ' ', '_'), '-', '_')")
    extra = {**TAG_CTES, "taxpos": tax,
             "tkeys": f"SELECT x.title_id, {safe} AS tag, tp.pos FROM tags_long x JOIN taxpos tp ON x.category = tp.category AND x.value = tp.value",
             "base": """SELECT user_id, count(*) AS total_rated, round_even(avg(rating), 1) AS avg_overall,
                   CASE WHEN count(*) FILTER (WHERE rating >= 7 AND runtime IS NOT NULL) > 5
                        THEN CAST(round_even(avg(CAST(runtime AS DOUBLE)) FILTER (WHERE rating >= 7), 0) AS INTEGER) END AS avg_runtime_liked
                   FROM history_full GROUP BY user_id""",
             "gst": """SELECT user_id, k AS gk, count(*) AS genre_count, round_even(avg(rating), 1) AS genre_avg
                   FROM history_full h JOIN (SELECT DISTINCT lower(nullif(trim(split_part(coalesce(genre, ''), ',', 1)), '')) AS k FROM title_info) n
                     ON contains(lower(h.genre), n.k) GROUP BY user_id, k HAVING count(*) >= 3""",
             "dst": """SELECT user_id, k AS dk, count(*) AS director_count, round_even(avg(rating), 1) AS director_avg
                   FROM history_full h JOIN (SELECT DISTINCT lower(nullif(trim(split_part(coalesce(director, ''), ',', 1)), '')) AS k FROM title_info) n
                     ON contains(lower(h.director), n.k) GROUP BY user_id, k HAVING count(*) >= 2""",
             "cand": f"""SELECT p.user_id, t.title_id, t.genre, t.director FROM title_info t, (SELECT DISTINCT c_mktsegment AS user_id FROM customer) p""",
             "tst": """SELECT h.user_id, k.tag, count(*) AS n, round_even(avg(h.rating), 1) AS ta
                   FROM history_full h JOIN tkeys k ON h.title_id = k.title_id GROUP BY ALL HAVING count(*) >= 5""",
             "top": """SELECT user_id, title_id, tag AS top_tag, ta AS top_tag_avg, n AS top_tag_count FROM (
                   SELECT c.user_id, c.title_id, s.tag, s.ta, s.n,
                          row_number() OVER (PARTITION BY c.user_id, c.title_id
                                             ORDER BY abs(s.ta - b.avg_overall) DESC, k.pos) AS rn
                   FROM cand c JOIN tkeys k ON c.title_id = k.title_id
                   JOIN tst s ON s.user_id = c.user_id AND s.tag = k.tag
                   JOIN base b ON b.user_id = c.user_id
                   WHERE abs(s.ta - b.avg_overall) > 0) WHERE rn = 1"""}
    sql = """
    SELECT c.user_id, c.title_id, b.total_rated, b.avg_overall, b.avg_runtime_liked,
           CASE WHEN g.genre_count IS NOT NULL THEN nullif(trim(split_part(coalesce(c.genre, ''), ',', 1)), '') END AS genre_name,
           g.genre_count, g.genre_avg, d.director_count, d.director_avg,
           tp.top_tag, tp.top_tag_avg, tp.top_tag_count
    FROM cand c LEFT JOIN base b ON c.user_id = b.user_id
    LEFT JOIN gst g ON g.user_id = c.user_id AND g.gk = lower(nullif(trim(split_part(coalesce(c.genre, ''), ',', 1)), ''))
    LEFT JOIN dst d ON d.user_id = c.user_id AND d.dk = lower(nullif(trim(split_part(coalesce(c.director, ''), ',', 1)), ''))
    LEFT JOIN top tp ON tp.user_id = c.user_id AND tp.title_id = c.title_id"""
    return extra, sql


@query("d7_preference_stats", _d7_sql())
def d7_preference_stats(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    info, h = V.stored_history(t)
    cands = people_titles(info, V.people(t)).select("user_id", "title_id", "genre", "director")
    keys = _tag_keys(spark, t)
    return prefs.preference_stats(h, cands, keys.select("title_id", "tag"), keys)
