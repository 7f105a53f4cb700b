"""Incremental queries: K1 (oracle: the flattened replies, first wins) and K2."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import encode as enc
from ..functions.display import match_pct
from ..session import ensure_checkpoint_dir
from ..streaming import incremental as K
from . import views as V
from .oracle_views import with_views
from .q_features import people_titles
from .q_ingest import FLAT_SQL, REPLY_SQL, metadata_replies
from .registry import query

def _land(spark, sf_dir, root):
    """Land the replies as two files: runtimes up to 90 minutes, then from
    63 minutes on -- the overlap arrives twice, the first copy must win."""
    t = V.Tables(spark, sf_dir)
    r = metadata_replies(t).withColumn("_ord", F.col("title_id"))
    s = t.part.select(F.col("p_partkey").alias("title_id"), "p_size")
    r = r.join(s, "title_id")
    r.filter(F.col("p_size") <= 30).drop("p_size").write.parquet(f"{root}/in/part=1")
    r.filter(F.col("p_size") > 20).drop("p_size").withColumn("_ord", F.col("_ord") + 10**9) \
     .write.parquet(f"{root}/in2")


def _run(spark, sf_dir, scorer=None):
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream/{uuid.uuid4().hex}"
    _land(spark, sf_dir, root)
    table, ckpt, catalog = f"{root}/titles", f"{root}/ckpt", f"{root}/catalog" if scorer else None
    K.incremental_enrich(spark, f"{root}/in/part=1", table, ckpt, catalog, scorer)
    # second file arrives; the query restarts from its checkpoint
    spark.read.parquet(f"{root}/in2").write.mode("append").parquet(f"{root}/in/part=1")
    K.incremental_enrich(spark, f"{root}/in/part=1", table, ckpt, catalog, scorer)
    return root


def _scorer(spark, sf_dir):
    """Mean of the three entity averages, for everyone who rates."""
    t = V.Tables(spark, sf_dir)
    h = V.history_full(t)
    stats, overall = enc.entity_stats(h), enc.overall_average(h)

    def score(new_titles):
        cand = people_titles(new_titles.select("title_id", "director", "actors", F.lit(None).cast("string").alias("studio")),
                             V.people(t))
        look = enc.lookup_entity_stats(cand, stats, overall)
        s = (F.col("director_avg_rating") + F.col("actor1_avg_rating") + F.col("studio_avg_rating")) / 3
        return new_titles.select("title_id", "title", "year", "runtime").join(
            look.select("title_id", "user_id", match_pct(s).alias("pct")), "title_id")
    return score


def _model_scorer(spark, sf_dir):
    """Everyone's score by the saved model of I4."""
    from . import model as MD
    from . import q_model as QM
    path = QM.model_path(spark, sf_dir)
    rows = QM.stored_score_rows(spark, sf_dir)

    def score(new_titles):
        titles = new_titles.select("title_id", "title", "year", "runtime")
        wanted = rows.join(titles.select("title_id"), "title_id", "left_semi")
        return titles.join(MD.boosted_score(wanted, path).select("title_id", "user_id", "pct"), "title_id")
    return score


@query("k1_incremental_enrich", with_views(
    "SELECT title_id, title, runtime, year FROM flat", extra={"replies": REPLY_SQL, "flat": FLAT_SQL}))
def k1_incremental_enrich(spark, sf_dir):
    root = _run(spark, sf_dir)
    out = K.read_stored(spark, f"{root}/titles")
    return out.select("title_id", "title", "runtime", "year")


def _k2_sql():
    from .q_features import ENTITY_CTES
    every = "(SELECT f.*, p.user_id FROM flat f, (SELECT DISTINCT c_mktsegment AS user_id FROM customer) p)"
    extra = {**ENTITY_CTES, "replies": REPLY_SQL, "flat": FLAT_SQL,
             "kc": f"""
        SELECT title_id, user_id, 'director' AS kind, nullif(trim(split_part(coalesce(director, ''), ',', 1)), '') AS entity FROM {every}
        UNION ALL SELECT title_id, user_id, 'actor1', nullif(trim(split_part(coalesce(actors, ''), ',', 1)), '') FROM {every}
        UNION ALL SELECT title_id, user_id, 'studio', 'Unknown' FROM {every}""",
             "look": """
        SELECT k.title_id, k.user_id, avg(coalesce(s.avg, o.overall_avg)) AS score
        FROM kc k LEFT JOIN estats s ON k.user_id = s.user_id AND k.kind = s.kind AND k.entity = s.entity
        LEFT JOIN overall o ON k.user_id = o.user_id GROUP BY k.title_id, k.user_id"""}
    sql = """
    SELECT f.title_id, f.title, f.year, f.runtime, l.user_id,
           round_even(least(greatest(l.score, 1.0), 10.0) * 10, 1) AS pct
    FROM flat f JOIN look l ON f.title_id = l.title_id"""
    return with_views(sql, "history_full", "title_info", extra=extra)


@query("k2_incremental_score", _k2_sql())
def k2_incremental_score(spark, sf_dir):
    """The catalog after both files: every stored title's score for everyone."""
    return K.read_stored(spark, _run(spark, sf_dir, _scorer(spark, sf_dir)) + "/catalog")


@query("k2_incremental_score_model")
def k2_incremental_score_model(spark, sf_dir):
    """The same with the saved model of I4 as the scorer."""
    return K.read_stored(spark, _run(spark, sf_dir, _model_scorer(spark, sf_dir)) + "/catalog")
