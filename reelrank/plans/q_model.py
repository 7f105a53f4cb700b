"""Model, explanation and flagship queries: I1-I8, D10, E3, E4, H23, B8, A10."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import boosting
from ..operators import encode as enc
from ..operators import explain as X
from ..operators import text_vectors
from ..operators.aggregates import feature_importance, group_medians
from ..operators.split import stratified_split
from ..functions import parse as P
from ..functions.display import clip_rating
from ..session import checkpoint, ensure_checkpoint_dir
from ..sources import ingest as I
from . import champions as C
from . import model as MD
from . import views as V
from .q_features import ENTITY_CTES, LOO_SQL, entity_sql, people_titles
from .q_ingest import FLAGS_SQL, FLAT_SQL, REPLY_SQL, metadata_replies
from .q_merge import guide, tags_long
from .registry import query
from ..operators import merge as M

VEC_DIM = 64


# ---------------------------------------------------------------- model inputs

def _title_attrs(spark, t):
    ti = V.title_info(t)
    cb = V.catalog_base(t).select("title_id", "imdb_score", "year")
    # the replies of a small file are spread over tasks before they are parsed
    replies = V.Tables(spark, t.sf_dir)
    replies.part = t.part.repartition("p_partkey")
    meta = I.flatten_metadata(metadata_replies(replies), keep=("title_id",)).select("title_id", "metascore", "imdb_votes", "rt_score", "award_wins", "award_noms",
                                        "oscar_win", "oscar_nom", "rated", "language", "country")
    g = M.join_guide(ti.select("title_id"), guide(t))
    tn = (tags_long(spark, replies).select("title_id", P.tag_column_name("category", "value").alias("n"))
          .groupBy("title_id").agg(F.collect_list("n").alias("tag_names")))   # <= tags per title
    vec = t.embeddings.select(F.col("vec_id").alias("title_id"), F.col("embedding").alias("vec"))
    return (ti.join(cb, "title_id").join(g, "title_id", "left").join(meta, "title_id", "left")
              .join(tn, "title_id", "left").join(vec, "title_id", "left"))


def _fill_stats(rows):
    """Per person: average and count of the train rows' ratings, and the
    medians that fill missing numbers."""
    train = rows.filter(~F.col("is_test"))
    return (train.groupBy("user_id").agg(F.avg("rating").alias("user_avg_rating"),
                                         F.count(F.lit(1)).cast("double").alias("user_n_rated"))
            .join(group_medians(train, MD.MEDIAN_FILLED), "user_id"))


def _stored_attrs(spark, t):
    """The titles' attributes, written once per data version."""
    return MD.stored(spark, "titles|" + _version(spark, t.sf_dir), lambda: _title_attrs(spark, t))


def _rated_rows(spark, t):
    """Everyone's ratings with attributes and the hold-out flag, written once
    per data version: the medians, the averages and the rows all read them."""
    def build():
        loo = checkpoint(enc.leave_one_out(V.stored_history(t)[1]))
        return stratified_split(loo.join(_stored_attrs(spark, t).hint("merge"), "title_id"))
    return MD.stored(spark, "rated|" + _version(spark, t.sf_dir), build)


def train_rows(spark, sf_dir):
    """Feature rows of everyone's ratings, with the hold-out flag.  The fill
    statistics come from the train rows alone."""
    t = V.Tables(spark, sf_dir)
    rows = _rated_rows(spark, t)
    # dealt anew: the small files of the ratings are few tasks' work
    rows = MD.feature_rows(rows.join(_fill_stats(rows), "user_id").repartition("user_id", "title_id"), VEC_DIM)
    return rows.select("user_id", "title_id", "rating", "slots", "genres", "is_test")


def score_rows(spark, sf_dir):
    """Feature rows of every (person, title)."""
    t = V.Tables(spark, sf_dir)
    info, h = V.stored_history(t)
    cand = people_titles(info, V.people(t)).select("user_id", "title_id", "director", "actors", "studio")
    look = enc.lookup_entity_stats(cand, enc.entity_stats(h), enc.overall_average(h)).drop("director", "actors", "studio")
    rows = look.join(_stored_attrs(spark, t).hint("merge"), "title_id").join(_fill_stats(_rated_rows(spark, t)), "user_id")
    return MD.feature_rows(rows.repartition("user_id", "title_id"), VEC_DIM).select("user_id", "title_id", "slots", "genres")


INPUTS = ["lineitem", "orders", "customer", "part", "documents", "labels", "embeddings"]


def _version(spark, sf_dir):
    """Of the inputs and of the feature list: another of either makes other
    tables and another model."""
    data = MD.data_version(spark, [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in INPUTS])
    return f"{data}|{MD.slot_names(VEC_DIM)}"


def stored_train_rows(spark, sf_dir):
    return MD.stored(spark, "train|" + _version(spark, sf_dir), lambda: train_rows(spark, sf_dir))


def model_path(spark, sf_dir, mode="pooled"):
    rows = stored_train_rows(spark, sf_dir).filter(~F.col("is_test"))
    return MD.boosted(rows, _version(spark, sf_dir), VEC_DIM, mode)


def stored_scores(spark, sf_dir, mode="pooled"):
    """I4's result with the feature arrays, written once per model."""
    path = model_path(spark, sf_dir, mode)
    rows = stored_score_rows(spark, sf_dir)
    return MD.stored(spark, "scores|" + path, lambda: MD.boosted_score(rows, path, mode))


def stored_score_rows(spark, sf_dir):
    return MD.stored(spark, "score rows|" + _version(spark, sf_dir), lambda: score_rows(spark, sf_dir))


# ---------------------------------------------------------------- I1, I2

def _split_ctes():
    """``attrs``: rated rows with their attributes; ``frows``: with the hold-out flag."""
    nums = ", ".join(f"m.{c}" for c in ("metascore", "imdb_votes", "rt_score", "award_wins", "award_noms",
                                        "oscar_win", "oscar_nom"))
    return {**ENTITY_CTES, "loo": LOO_SQL, "replies": REPLY_SQL, "flat": FLAT_SQL,
            "attrs": f"""
        SELECT l.*, c.imdb_score, t.box_office, t.runtime, c.year, {nums}
        FROM loo l JOIN title_info t ON l.title_id = t.title_id
        JOIN catalog_base c ON l.title_id = c.title_id LEFT JOIN flat m ON l.title_id = m.title_id""",
            "frows": """
        SELECT * EXCLUDE (rn, n, bin), bin IS NOT NULL AND rn <= round(n * 0.2) AS is_test FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, bin ORDER BY md5(CAST(title_id AS VARCHAR) || ':42'), title_id) AS rn,
                    count(*) OVER (PARTITION BY user_id, bin) AS n
          FROM (SELECT *, CASE WHEN rating > 0 AND rating <= 3 THEN 0 WHEN rating > 3 AND rating <= 5 THEN 1
                            WHEN rating > 5 AND rating <= 7 THEN 2 WHEN rating > 7 AND rating <= 8 THEN 3
                            WHEN rating > 8 AND rating <= 10 THEN 4 END AS bin FROM attrs))"""}


def _split_sql(sql, **extra):
    from .oracle_views import with_views
    return with_views(sql, "history_full", "title_info", "catalog_base", extra={**_split_ctes(), **extra})


def _i1_sql():
    from .q_merge import GUIDE_SQL, TAG_CTES
    ords = [f"coalesce(CASE g.{c} WHEN 'None' THEN 0 WHEN 'Mild' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Severe' THEN 3 END, -1)"
            for c in MD.GUIDE_COLUMNS]
    nums = [f"coalesce(CAST(f.{c} AS DOUBLE), {f'u.med_{c}, ' if c in MD.MEDIAN_FILLED else ''}0.0)"
            for c in MD.NUMERIC_FROM.values()]
    decades = ["d < 1970", "d = 1970", "d = 1980", "d = 1990", "d = 2000", "d = 2010", "d >= 2020"]
    flags = [f"(floor(coalesce(f.year, 2000) / 10) * 10 {x[2:]})" for x in decades]
    flags += [f"coalesce(w.{c}, {int(c in ('rated_NR', 'lang_other', 'country_other'))})" for c in MD.FLAGS[len(decades):]]
    tags = ["list_contains(k.names, '{}')".format(n.replace("'", "''")) for n in MD.TAGS]
    slots = nums + [f"f.{c}" for c in MD.ENTITY] + ["u.mu", "u.n"] + flags + [f"coalesce({x}, false)" for x in tags] + ords
    listed = ", ".join(f"CAST({x} AS DOUBLE)" for x in slots)
    meds = ", ".join(f"median({c}) AS med_{c}" for c in MD.MEDIAN_FILLED)
    return _split_sql(f"""
    SELECT user_id, title_id, rating, is_test, CAST(len(x) AS INTEGER) AS n_slots,
           list_sum(list_transform(x, lambda v: v / (1 + abs(v)))) AS slot_sum,
           list_sum(list_transform(x, lambda v, i: i * (v / (1 + abs(v))))) AS slot_places
    FROM (SELECT f.user_id, f.title_id, f.rating, f.is_test,
                 [{listed}] || coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(range({VEC_DIM}), lambda v: 0.0)) AS x
          FROM frows f JOIN ustats u ON f.user_id = u.user_id
          LEFT JOIN guide g ON f.title_id = g.title_id LEFT JOIN ntags k ON f.title_id = k.title_id
          LEFT JOIN flags w ON f.title_id = w.title_id
          LEFT JOIN embeddings e ON e.vec_id = f.title_id)""",
        ustats=f"""SELECT user_id, avg(rating) AS mu, CAST(count(*) AS DOUBLE) AS n, {meds}
                   FROM frows WHERE NOT is_test GROUP BY user_id""",
        flags=FLAGS_SQL, **TAG_CTES, guide=GUIDE_SQL,
        ntags="""SELECT title_id, list('tag_' || category || '_' ||
                 replace(replace(replace(replace(value, '&', 'and'), '/', '_'), ' ', '_'), '-', '_')) AS names
                 FROM tags_long GROUP BY title_id""")


@query("i1_build_features", _i1_sql())
def i1_build_features(spark, sf_dir):
    """Slots are compared by two sums over x / (1 + |x|), one weighted by the
    slot's place, so that a swap of slots shows."""
    def squash(x):
        return x / (1 + F.abs(x))
    places = F.transform("slots", lambda x, i: (i + 1) * squash(x))
    return train_rows(spark, sf_dir).select(
        "user_id", "title_id", "rating", "is_test", F.size("slots").alias("n_slots"),
        F.aggregate("slots", F.lit(0.0), lambda a, x: a + squash(x)).alias("slot_sum"),
        F.aggregate(places, F.lit(0.0), lambda a, x: a + x).alias("slot_places"))


@query("i2_embed_text", rf"""
    SELECT doc_id, CAST({VEC_DIM} AS INTEGER) AS dim,
           CAST(CASE WHEN regexp_matches(coalesce(text, ''), '\w\w') THEN 1 ELSE 0 END AS DOUBLE) AS norm
    FROM documents""")
def i2_embed_text(spark, sf_dir):
    """Width and length of each vector: 1, or 0 for a text without a word of
    two letters."""
    docs = V.Tables(spark, sf_dir).documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = MD.embed_text(docs, "text", dim=VEC_DIM)
    return out.select("doc_id", F.size("vec").alias("dim"),
                      F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


TRAINED_DIM = 384


@query("i2_trained_vectors", rf"""
    SELECT doc_id, CAST({TRAINED_DIM} AS INTEGER) AS dim,
           CAST(CASE WHEN regexp_matches(coalesce(text, ''), '\w\w') THEN 1 ELSE 0 END AS DOUBLE) AS norm
    FROM documents""")
def i2_trained_vectors(spark, sf_dir):
    """Width and length of the trained vectors of all documents."""
    docs = V.Tables(spark, sf_dir).documents.select("doc_id", "text")
    out = text_vectors.embed_svd(docs, "text", text_vectors.fit_svd(docs, "text", TRAINED_DIM))
    return out.select("doc_id", F.size("vec").alias("dim"),
                      F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


# ---------------------------------------------------------------- I3, I4, A10, I6

@query("i3_train_and_evaluate")
def i3_train_and_evaluate(spark, sf_dir):
    """Fit (once) and report hold-out MAE / RMSE / R^2 per person with the
    'predict the mean' baseline beside it."""
    test, base = _held_out(spark, sf_dir)
    return MD.evaluate(MD.boosted_predict(test, model_path(spark, sf_dir))).join(base, "user_id")


def _held_out(spark, sf_dir):
    """Hold-out rows, and the error there of each person's train mean."""
    rows = stored_train_rows(spark, sf_dir)
    test = rows.filter(F.col("is_test"))
    mean = rows.filter(~F.col("is_test")).groupBy("user_id").agg(F.avg("rating").alias("_mu"))
    base = (test.join(mean, "user_id").groupBy("user_id")
                .agg(F.avg(F.abs(F.col("rating") - F.col("_mu"))).alias("baseline_mae"),
                     F.count(F.lit(1)).alias("n_test")))
    return test, base


@query("i3_evaluate_per_person")
def i3_evaluate_per_person(spark, sf_dir):
    """Hold-out MAE / RMSE / R^2 of each person's own trees, all people's grown
    at once, beside the pooled model's MAE and the mean's.

    A leave-one-out average is a function of the row's own rating, which trees
    can read back; ``unseen_mae`` is the error on the same rows when their
    entities are looked up in the train rows, as a title's that nobody rated.
    """
    test, base = _held_out(spark, sf_dir)
    path = model_path(spark, sf_dir, "per_user")
    pooled = MD.evaluate(MD.boosted_predict(test, model_path(spark, sf_dir))).select("user_id", F.col("mae").alias("pooled_mae"))
    own = MD.evaluate(MD.boosted_predict(test, path, "per_user"))
    unseen = MD.evaluate(MD.boosted_predict(_looked_up(spark, sf_dir), path, "per_user")).select(
        "user_id", F.col("mae").alias("unseen_mae"))
    return own.join(pooled, "user_id").join(unseen, "user_id").join(base, "user_id")


def _looked_up(spark, sf_dir):
    """Feature rows of the hold-out ratings, entities encoded by C6 from the
    train rows alone."""
    rows = _rated_rows(spark, V.Tables(spark, sf_dir))
    train, test = rows.filter(~F.col("is_test")), rows.filter(F.col("is_test"))
    look = enc.lookup_entity_stats(test.select("user_id", "title_id", "director", "actors", "studio"),
                                   enc.entity_stats(train), enc.overall_average(train))
    plain = test.drop(*MD.ENTITY).join(look, ["user_id", "title_id"]).join(_fill_stats(rows), "user_id")
    return MD.feature_rows(plain, VEC_DIM).select("user_id", "title_id", "rating", "slots", "genres")


@query("i3_evaluation_checked", _split_sql("""
    SELECT t.user_id, count(*) AS n_test, avg(abs(t.rating - m.mu)) AS baseline_mae, true AS metrics_ok
    FROM frows t JOIN (SELECT user_id, avg(rating) AS mu FROM frows WHERE NOT is_test GROUP BY user_id) m
      ON t.user_id = m.user_id WHERE t.is_test GROUP BY t.user_id"""))
def i3_evaluation_checked(spark, sf_dir):
    """I3 beside SQL: hold-out rows and baseline; the metrics must lie in range."""
    m = i3_train_and_evaluate(spark, sf_dir)
    ok = F.col("mae").between(0, F.col("rmse")) & (F.col("rmse") <= 9) & (F.col("r2") <= 1)
    return m.select("user_id", "n_test", "baseline_mae", F.coalesce(ok, F.lit(False)).alias("metrics_ok"))


@query("i4_score_catalog")
def i4_score_catalog(spark, sf_dir):
    return stored_scores(spark, sf_dir).drop("x")


@query("i4_score_catalog_per_person")
def i4_score_catalog_per_person(spark, sf_dir):
    """Every title's score for each person by that person's own trees."""
    return stored_scores(spark, sf_dir, "per_user").drop("x")


PEOPLE_TITLES_SQL = """(SELECT DISTINCT c_mktsegment AS user_id FROM customer) p,
                       (SELECT p_partkey AS title_id FROM part) t"""


@query("i4_scores_checked", f"SELECT user_id, title_id, true AS score_ok, true AS pct_ok FROM {PEOPLE_TITLES_SQL}")
def i4_scores_checked(spark, sf_dir):
    """I4 beside SQL: one score for every person and title, within 1 to 10,
    and its match % by H20's formula."""
    s = i4_score_catalog(spark, sf_dir)
    off = F.abs(F.col("pct") - F.col("score") * 10)
    return s.select("user_id", "title_id", F.coalesce(F.col("score").between(1, 10), F.lit(False)).alias("score_ok"),
                    F.coalesce(off <= 0.0501, F.lit(False)).alias("pct_ok"))


@query("a10_sample_predictions")
def a10_sample_predictions(spark, sf_dir):
    test = stored_train_rows(spark, sf_dir).filter(F.col("is_test"))
    return MD.sample_predictions(MD.boosted_predict(test, model_path(spark, sf_dir)))


@query("a10_samples_checked", _split_sql("""
    SELECT user_id, title_id, rating, true AS in_range FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY title_id) AS rn FROM frows WHERE is_test)
    WHERE rn <= 10"""))
def a10_samples_checked(spark, sf_dir):
    return a10_sample_predictions(spark, sf_dir).select(
        "user_id", "title_id", "rating", F.coalesce(F.col("predicted").between(1, 10), F.lit(False)).alias("in_range"))


def _metrics_sql(pred):
    return f"""SELECT user_id, avg(abs(e)) AS mae,
           1 - sum(e * e) / nullif(sum((rating - mu) * (rating - mu)), 0.0) AS r2
    FROM (SELECT l.user_id, l.rating, l.rating - least(greatest(l.{pred}, 1.0), 10.0) AS e,
                 avg(l.rating) OVER (PARTITION BY l.user_id) AS mu
          FROM ({LOO_SQL}) l) GROUP BY user_id"""


@query("i6_promote_if_better", entity_sql("""
    SELECT n.user_id, n.mae AS new_mae, n.r2 AS new_r2, c.mae AS cur_mae, c.r2 AS cur_r2,
           c.mae IS NULL OR c.mae - n.mae >= 0.005 - 1e-12 OR n.r2 - c.r2 >= 0.005 - 1e-12 AS promote
    FROM chal n LEFT JOIN champ c ON n.user_id = c.user_id""",
    {"chal": _metrics_sql("director_avg_rating"), "champ": _metrics_sql("actor1_avg_rating")}))
def i6_promote_if_better(spark, sf_dir):
    """The rule on two metric tables: challenger = the leave-one-out director
    mean, champion = the first actor's."""
    loo = checkpoint(enc.leave_one_out(V.history_full(V.Tables(spark, sf_dir), "rating")).select(
        "user_id", "rating", "director_avg_rating", "actor1_avg_rating"))
    chal, champ = (MD.evaluate(loo.withColumn("prediction", F.col(c)))
                   for c in ("director_avg_rating", "actor1_avg_rating"))
    return MD.promote_if_better(chal, champ)


def _two_submissions(spark, sf_dir):
    """Two versions submitted to an empty registry: the first actor's
    leave-one-out mean, then the director's.  Both read one history and one
    leave-one-out table, written once."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    h = checkpoint(V.history_full(V.Tables(spark, sf_dir), "rating").select("user_id", "title_id", "rating", "director", "actors", "studio"))
    loo = checkpoint(enc.leave_one_out(h).select("user_id", "rating", "actor1_avg_rating", "director_avg_rating"))
    for version, column in (("v1", "actor1_avg_rating"), ("v2", "director_avg_rating")):
        C.submit(spark, base, version, MD.evaluate(loo.withColumn("prediction", F.col(column))), f"{base}/{version}",
                 {"entity_stats": enc.entity_stats(h), "history": h.select("user_id", "title_id", "rating")})
    return base


METRIC_CTES = {"m1": _metrics_sql("actor1_avg_rating"), "m2": _metrics_sql("director_avg_rating")}


@query("i6_current_model", entity_sql("""
    SELECT a.user_id, CASE WHEN up THEN 'v2' ELSE 'v1' END AS model_version,
           CASE WHEN up THEN b.mae ELSE a.mae END AS mae, CASE WHEN up THEN b.r2 ELSE a.r2 END AS r2
    FROM (SELECT m1.*, m1.mae - m2.mae >= 0.005 - 1e-12 OR m2.r2 - m1.r2 >= 0.005 - 1e-12 AS up
          FROM m1 JOIN m2 ON m1.user_id = m2.user_id) a JOIN m2 b ON a.user_id = b.user_id""", METRIC_CTES))
def i6_current_model(spark, sf_dir):
    """Each person's current model, read back after both submissions."""
    return C.current_models(spark, _two_submissions(spark, sf_dir)).select("user_id", "model_version", "mae", "r2")


@query("a10_saved_metrics", entity_sql("""
    SELECT 'v1' AS model_version, user_id, mae, r2 FROM m1 UNION ALL SELECT 'v2', user_id, mae, r2 FROM m2""", METRIC_CTES))
def a10_saved_metrics(spark, sf_dir):
    return C.saved_metrics(spark, _two_submissions(spark, sf_dir)).select("model_version", "user_id", "mae", "r2")


@query("a9_saved_entity_stats", entity_sql("SELECT user_id, kind, entity, n, avg FROM estats"))
def a9_saved_entity_stats(spark, sf_dir):
    """A side table of the second version, read back."""
    return C.saved_table(spark, _two_submissions(spark, sf_dir), "v2", "entity_stats").select("user_id", "kind", "entity", "n", "avg")


@query("a9_saved_run")
def a9_saved_run(spark, sf_dir):
    """The trained model submitted with all its side tables; rows of each as read back."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    t, path = V.Tables(spark, sf_dir), model_path(spark, sf_dir)
    h = V.history_full(t, "rating")
    test, _ = _held_out(spark, sf_dir)
    side = {"entity_stats": enc.entity_stats(h), "feature_names": MD.boosted_names(spark, path), "trees": MD.trees(spark, path),
            "history": h.select("user_id", "title_id", "rating").join(
                t.embeddings.select(F.col("vec_id").alias("title_id"), "embedding"), "title_id", "left")}
    C.submit(spark, base, "pooled", MD.evaluate(MD.boosted_predict(test, path)), path, side)
    out = C.current_models(spark, base).select(F.lit("current_model").alias("name"))
    for name in side:
        out = out.unionByName(C.saved_table(spark, base, "pooled", name).select(F.lit(name).alias("name")))
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- I5, E3, E4, D10 on the model

def _contributions(spark, sf_dir):
    scored = stored_scores(spark, sf_dir)
    return contributions_of(spark, sf_dir, scored), scored


def contributions_of(spark, sf_dir, scored):
    """I5 of scored rows with their features' names."""
    path = model_path(spark, sf_dir)
    c = boosting.explain(scored, MD.trees(spark, path), keep=["user_id", "title_id"])
    names = F.broadcast(MD.boosted_names(spark, path))          # bounded by the model's width
    return c.join(names, "feature_index")


@query("i5_explain")
def i5_explain(spark, sf_dir):
    c, scored = _contributions(spark, sf_dir)
    return c.select("user_id", "title_id", "feature", "value", "contrib", "base", "walk_pred")


@query("i5_explanations_checked", f"SELECT user_id, title_id, true AS additive FROM {PEOPLE_TITLES_SQL}")
def i5_explanations_checked(spark, sf_dir):
    """I5 beside SQL: every person and title is explained, and base plus
    contributions is the prediction that was scored."""
    c, scored = _contributions(spark, sf_dir)
    total = (c.groupBy("user_id", "title_id")
             .agg((F.first("base") + F.sum("contrib")).alias("sum"), F.first("walk_pred").alias("walk"))
             .withColumn("clipped", clip_rating("sum")))
    ok = (F.abs(F.col("sum") - F.col("walk")) < 1e-6) & (F.abs(F.col("clipped") - F.col("score")) < 1e-6)
    return (scored.select("user_id", "title_id", "score").join(total, ["user_id", "title_id"], "left")
            .select("user_id", "title_id", F.coalesce(ok, F.lit(False)).alias("additive")))


@query("e3_top_drivers_model")
def e3_top_drivers_model(spark, sf_dir):
    c, _ = _contributions(spark, sf_dir)
    return X.top_drivers(c.filter("contrib <> 0"))


@query("e4_top_signed_model")
def e4_top_signed_model(spark, sf_dir):
    c, _ = _contributions(spark, sf_dir)
    return X.top_signed(c.filter("contrib <> 0"))


@query("d10_feature_importance_model")
def d10_feature_importance_model(spark, sf_dir):
    c, _ = _contributions(spark, sf_dir)
    return feature_importance(c.filter("contrib <> 0"), 15)
