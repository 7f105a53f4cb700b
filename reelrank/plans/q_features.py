"""Feature queries: E1, D1-D4, C6, D9 and similarity C9, C10, D8, H21, H22."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.display import similarity_pct, similarity_pct_api
from ..operators import aggregates as agg
from ..operators import encode as enc
from ..operators import similarity as sim
from ..session import checkpoint
from . import views as V
from .oracle_views import with_views
from .registry import query

A, B = V.PERSON_A, V.PERSON_B

# ---------------------------------------------------------------- SQL pieces

ENTITY_CTES = {
    "hx": """
        SELECT user_id, title_id, rating,
               nullif(trim(split_part(coalesce(director, ''), ',', 1)), '') AS e_director,
               nullif(trim(split_part(coalesce(actors, ''), ',', 1)), '') AS e_actor1,
               coalesce(CASE WHEN trim(studio) IN ('', 'N/A') THEN NULL ELSE trim(studio) END,
                        'Unknown') AS e_studio
        FROM history_full""",
    "hlong": """
        SELECT user_id, title_id, rating, 'director' AS kind, e_director AS entity FROM hx
        UNION ALL SELECT user_id, title_id, rating, 'actor1', e_actor1 FROM hx
        UNION ALL SELECT user_id, title_id, rating, 'studio', e_studio FROM hx""",
    "overall": "SELECT user_id, avg(rating) AS overall_avg FROM history_full GROUP BY user_id",
    "estats": """
        SELECT user_id, kind, entity, count(rating) AS n, avg(rating) AS avg, sum(rating) AS s
        FROM hlong WHERE entity IS NOT NULL GROUP BY ALL""",
}


def entity_sql(sql, more=None):
    return with_views(sql, "history_full", "title_info", extra={**ENTITY_CTES, **(more or {})})


def _hist(spark, sf_dir):
    return V.history_full(V.Tables(spark, sf_dir), "rating")


@query("d1_overall_average", entity_sql("SELECT user_id, overall_avg FROM overall"))
def d1_overall_average(spark, sf_dir):
    return enc.overall_average(_hist(spark, sf_dir))


@query("d4_entity_stats", entity_sql("SELECT user_id, kind, entity, n, avg FROM estats"))
def d4_entity_stats(spark, sf_dir):
    return enc.entity_stats(_hist(spark, sf_dir))


LOO_SQL = """
    SELECT l.user_id, l.title_id, l.rating,
      max(CASE WHEN kind = 'director' THEN cnt END) AS director_film_count,
      max(CASE WHEN kind = 'director' THEN av END) AS director_avg_rating,
      max(CASE WHEN kind = 'actor1' THEN cnt END) AS actor1_film_count,
      max(CASE WHEN kind = 'actor1' THEN av END) AS actor1_avg_rating,
      max(CASE WHEN kind = 'studio' THEN cnt END) AS studio_film_count,
      max(CASE WHEN kind = 'studio' THEN av END) AS studio_avg_rating
    FROM (
      SELECT h.user_id, h.title_id, h.rating, h.kind,
             coalesce(s.n, 1) - 1 AS cnt,
             coalesce((s.s - h.rating) / nullif(coalesce(s.n, 1) - 1, 0), o.overall_avg) AS av
      FROM hlong h LEFT JOIN estats s
        ON h.user_id = s.user_id AND h.kind = s.kind AND h.entity = s.entity
      JOIN overall o ON h.user_id = o.user_id) l
    GROUP BY l.user_id, l.title_id, l.rating"""


@query("e1_leave_one_out", entity_sql(LOO_SQL))
def e1_leave_one_out(spark, sf_dir):
    return enc.leave_one_out(_hist(spark, sf_dir))


C6_CTES = {
    "cand": f"""
      SELECT p.user_id, t.* FROM title_info t, (SELECT DISTINCT c_mktsegment AS user_id FROM customer) p
      WHERE NOT EXISTS (SELECT 1 FROM history_full h
                        WHERE h.user_id = p.user_id AND h.title_id = t.title_id)""",
    "clong": """
      SELECT user_id, title_id, 'director' AS kind,
             nullif(trim(split_part(coalesce(director, ''), ',', 1)), '') AS entity FROM cand
      UNION ALL SELECT user_id, title_id, 'actor1',
             nullif(trim(split_part(coalesce(actors, ''), ',', 1)), '') FROM cand
      UNION ALL SELECT user_id, title_id, 'studio',
             coalesce(CASE WHEN trim(studio) IN ('', 'N/A') THEN NULL ELSE trim(studio) END,
                      'Unknown') FROM cand""",
}
C6_SQL = """
    SELECT c.user_id, c.title_id,
      max(CASE WHEN c.kind = 'director' THEN coalesce(s.n, 0) END) AS director_film_count,
      max(CASE WHEN c.kind = 'director' THEN coalesce(s.avg, o.overall_avg) END) AS director_avg_rating,
      max(CASE WHEN c.kind = 'actor1' THEN coalesce(s.n, 0) END) AS actor1_film_count,
      max(CASE WHEN c.kind = 'actor1' THEN coalesce(s.avg, o.overall_avg) END) AS actor1_avg_rating,
      max(CASE WHEN c.kind = 'studio' THEN coalesce(s.n, 0) END) AS studio_film_count,
      max(CASE WHEN c.kind = 'studio' THEN coalesce(s.avg, o.overall_avg) END) AS studio_avg_rating
    FROM clong c LEFT JOIN estats s ON c.user_id = s.user_id AND c.kind = s.kind AND c.entity = s.entity
    LEFT JOIN overall o ON c.user_id = o.user_id
    GROUP BY c.user_id, c.title_id"""


def people_titles(df, people, block=1000):
    """Every row of ``df`` once per row of ``people`` (user_id, each once).

    People are gathered into lists of about ``block``; a row meets every list
    by the list's number and is exploded over it, so that neither side need
    fit anywhere whole."""
    blocks = -(-people.count() // block) or 1
    lists = (people.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(blocks)).alias("_block"))
             .agg(F.collect_list("user_id").alias("_people")))
    met = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(lists, "_block")
    return met.withColumn("user_id", F.explode("_people")).drop("_block", "_people")


def unseen_candidates(t):
    h = V.history_full(t, "rating")
    return people_titles(V.title_info(t), V.people(t)).join(
        h.select("user_id", "title_id"), ["user_id", "title_id"], "left_anti")


@query("c6_lookup_entity_stats", entity_sql(C6_SQL, C6_CTES))
def c6_lookup_entity_stats(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    h = V.history_full(t, "rating")
    return enc.lookup_entity_stats(unseen_candidates(t), enc.entity_stats(h),
                                   enc.overall_average(h))


# ---------------------------------------------------------------- D2, D3, D9

NULLED = """CASE WHEN runtime % 7 = 0 THEN NULL ELSE runtime END"""


def _nulled(df):
    return df.withColumn("runtime", F.when(F.col("runtime") % 7 == 0, None)
                         .otherwise(F.col("runtime")))


@query("d2_median_impute", entity_sql(f"""
    SELECT h.user_id, h.title_id,
           coalesce(CAST({NULLED} AS DOUBLE), m.m_runtime) AS runtime,
           coalesce(CAST(h.box_office AS DOUBLE), m.m_box) AS box_office
    FROM history_full h JOIN (
        SELECT user_id, median(CAST({NULLED} AS DOUBLE)) AS m_runtime,
               median(CAST(box_office AS DOUBLE)) AS m_box
        FROM history_full GROUP BY user_id) m ON h.user_id = m.user_id"""))
def d2_median_impute(spark, sf_dir):
    df = _nulled(_hist(spark, sf_dir)).select("user_id", "title_id", "runtime", "box_office")
    return agg.median_impute(df, ["runtime", "box_office"])


@query("d3_standardise", entity_sql(f"""
    SELECT h.user_id, h.title_id,
           (coalesce(CAST({NULLED} AS DOUBLE), m.mu_r) - m.mu_r)
              / CASE WHEN m.sd_r IS NULL OR m.sd_r = 0 THEN 1.0 ELSE m.sd_r END AS runtime,
           (CAST(h.rating AS DOUBLE) - m.mu_x)
              / CASE WHEN m.sd_x IS NULL OR m.sd_x = 0 THEN 1.0 ELSE m.sd_x END AS rating
    FROM history_full h JOIN (
        SELECT user_id, avg(CAST({NULLED} AS DOUBLE)) AS mu_r, stddev_pop(CAST({NULLED} AS DOUBLE)) AS sd_r,
               avg(rating) AS mu_x, stddev_pop(rating) AS sd_x
        FROM history_full GROUP BY user_id) m ON h.user_id = m.user_id"""))
def d3_standardise(spark, sf_dir):
    df = _nulled(_hist(spark, sf_dir)).select("user_id", "title_id", "runtime", "rating")
    stats = agg.scaler_stats(df, ["runtime", "rating"])
    return agg.standardise(df, stats, ["runtime", "rating"])


@query("d9_regression_metrics", entity_sql(f"""
    SELECT user_id, count(*) AS n,
           avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
           1 - sum(e * e) / nullif(sum((rating - mu) * (rating - mu)), 0.0) AS r2
    FROM (SELECT l.user_id, l.rating,
                 l.rating - least(greatest(l.director_avg_rating, 1.0), 10.0) AS e,
                 avg(l.rating) OVER (PARTITION BY l.user_id) AS mu
          FROM ({LOO_SQL}) l) GROUP BY user_id"""))
def d9_regression_metrics(spark, sf_dir):
    """D9 with the leave-one-out director average as the prediction."""
    loo = enc.leave_one_out(_hist(spark, sf_dir))
    return agg.regression_metrics(loo.withColumn("prediction", F.col("director_avg_rating")))


# ---------------------------------------------------------------- C9, C10, D8, H21, H22

def _sim_inputs(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    tv = V.title_vectors(t)
    q = people_titles(tv, V.people(t)).select("user_id", F.col("title_id").alias("id"),
                                         "vec", "tags", "score")
    h = (V.history(t, "rating", titles=tv)
           .select("user_id", "title_id", "rating")
           .join(tv, "title_id")
           .select("user_id", F.col("title_id").alias("id"), "vec", "tags", "score", "rating"))
    return q, h


SIM_CTES = {
    "hv": f"""SELECT h.user_id, h.title_id AS id, t.vec, t.tags, t.score, h.rating
              FROM history h JOIN title_vectors t ON h.title_id = t.title_id""",
    "qv": f"""SELECT p.user_id, t.title_id AS id, t.vec, t.tags, t.score
              FROM title_vectors t, (SELECT DISTINCT c_mktsegment AS user_id FROM customer) p""",
    "pairs": """
      SELECT q.user_id, q.id AS query_id, h.id AS match_id,
        CASE WHEN q.id = h.id THEN -1.0
             WHEN len(q.tags) > 0 THEN
               0.6 * greatest(least(list_cosine_similarity(q.vec::DOUBLE[], h.vec::DOUBLE[]), 1.0), 0.0)
             + 0.3 * CASE WHEN len(list_distinct(list_concat(q.tags, h.tags))) > 0
                          THEN len(list_intersect(q.tags, h.tags)) / len(list_distinct(list_concat(q.tags, h.tags)))
                          ELSE 0.0 END
             + 0.1 * greatest(least(1.0 - abs(coalesce(h.score, 5.0) - coalesce(q.score, 5.0)) / 10.0, 1.0), 0.0)
             ELSE
               0.85 * greatest(least(list_cosine_similarity(q.vec::DOUBLE[], h.vec::DOUBLE[]), 1.0), 0.0)
             + 0.15 * greatest(least(1.0 - abs(coalesce(h.score, 5.0) - coalesce(q.score, 5.0)) / 10.0, 1.0), 0.0)
        END AS similarity
      FROM qv q JOIN hv h ON q.user_id = h.user_id""",
    "best": """
      SELECT user_id, query_id, match_id, similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, query_id
                                     ORDER BY similarity DESC, match_id) AS rn FROM pairs)
      WHERE rn = 1""",
}


def sim_sql(sql):
    return with_views(sql, "history", "title_vectors", extra=SIM_CTES)


def _best(spark, sf_dir, threshold=0.0):
    q, h = _sim_inputs(spark, sf_dir)
    return sim.nearest_rated(q, h, threshold=threshold, exclude_self=True)


@query("c9_nearest_rated", sim_sql("""
    SELECT b.user_id, b.query_id, b.match_id, round(b.similarity, 6) AS similarity,
           h.rating AS match_rating,
           CAST(least(100, floor(b.similarity / 0.65 * 100)) AS INTEGER) AS similarity_pct,
           CAST(round_even(b.similarity * 100, 0) AS INTEGER) AS match_pct_api
    FROM best b JOIN hv h ON b.user_id = h.user_id AND b.match_id = h.id
    WHERE b.similarity >= 0.0"""))
def c9_nearest_rated(spark, sf_dir):
    q, h = map(checkpoint, _sim_inputs(spark, sf_dir))
    best = sim.nearest_rated(q, h, threshold=0.0, exclude_self=True)
    hr = h.select("user_id", F.col("id").alias("match_id"), F.col("rating").alias("match_rating"))
    return best.join(hr, ["user_id", "match_id"]).select(
        "user_id", "query_id", "match_id", F.round("similarity", 6).alias("similarity"),
        "match_rating", similarity_pct("similarity").alias("similarity_pct"),
        similarity_pct_api("similarity").alias("match_pct_api"))


@query("c10_closest_for_pair", sim_sql(f"""
    , ba AS (SELECT * FROM best WHERE user_id = '{A}' AND similarity >= 0.52),
    bb AS (SELECT * FROM best WHERE user_id = '{B}'),
    ra AS (SELECT id, rating FROM hv WHERE user_id = '{A}'),
    rb AS (SELECT id, rating FROM hv WHERE user_id = '{B}')
    SELECT coalesce(a.query_id, b.query_id) AS query_id,
           a.match_id AS a_match, round(a.similarity, 6) AS a_sim, ra.rating AS a_rating,
           CASE WHEN rb1.id IS NOT NULL THEN a.match_id ELSE b.match_id END AS b_match,
           round(CASE WHEN rb1.id IS NOT NULL THEN a.similarity ELSE b.similarity END, 6) AS b_sim,
           CASE WHEN rb1.id IS NOT NULL THEN rb1.rating ELSE rb2.rating END AS b_rating
    FROM ba a LEFT JOIN ra ON a.match_id = ra.id
    LEFT JOIN rb rb1 ON a.match_id = rb1.id
    FULL JOIN bb b ON a.query_id = b.query_id
    LEFT JOIN rb rb2 ON b.match_id = rb2.id"""))
def c10_closest_for_pair(spark, sf_dir):
    q, h = (checkpoint(x.filter(F.col("user_id").isin(A, B))) for x in _sim_inputs(spark, sf_dir))
    best = checkpoint(sim.nearest_rated(q, h, threshold=0.0, exclude_self=True))
    best_a = best.filter(F.col("user_id") == A)
    best_b = best.filter(F.col("user_id") == B)
    out = sim.closest_for_pair(best_a, best_b, h.select("user_id", "id", "rating"), A, B)
    return out.withColumn("a_sim", F.round("a_sim", 6)).withColumn("b_sim", F.round("b_sim", 6))


@query("d8_taste_centroid", sim_sql("""
    SELECT user_id, CAST(pos AS INTEGER) AS pos,
           round(CASE WHEN count(*) FILTER (WHERE rating >= 8) > 0
                      THEN avg(v) FILTER (WHERE rating >= 8) ELSE avg(v) END, 6) AS value
    FROM (SELECT user_id, rating, unnest(vec)::DOUBLE AS v,
                 generate_subscripts(vec, 1) - 1 AS pos FROM hv)
    GROUP BY user_id, pos"""))
def d8_taste_centroid(spark, sf_dir):
    _, h = _sim_inputs(spark, sf_dir)
    c = sim.taste_centroid(h.select("user_id", "vec", "rating"))
    return c.select("user_id", F.posexplode("centroid").alias("pos", "value")).select(
        "user_id", F.col("pos").cast("int"), F.round("value", 6).alias("value"))


@query("h21_vibe_pct", sim_sql("""
    , cen AS (
      SELECT user_id, list(value ORDER BY pos) AS centroid FROM (
        SELECT user_id, pos,
               CASE WHEN count(*) FILTER (WHERE rating >= 8) > 0
                    THEN avg(v) FILTER (WHERE rating >= 8) ELSE avg(v) END AS value
        FROM (SELECT user_id, rating, unnest(vec)::DOUBLE AS v,
                     generate_subscripts(vec, 1) - 1 AS pos FROM hv)
        GROUP BY user_id, pos) GROUP BY user_id)
    SELECT q.user_id, q.id AS title_id,
           round_even(least(greatest((list_cosine_similarity(q.vec::DOUBLE[], c.centroid) + 1) / 2 * 100,
                                     0.0), 100.0), 1) AS vibe_pct
    FROM qv q JOIN cen c ON q.user_id = c.user_id"""))
def h21_vibe_pct(spark, sf_dir):
    q, h = _sim_inputs(spark, sf_dir)
    c = sim.taste_centroid(h.select("user_id", "vec", "rating"))
    return sim.vibe_scores(q, c).select("user_id", F.col("id").alias("title_id"), "vibe_pct")
