"""Merge, join and set-operation queries: C1-C5, C8, C11-C15, G1-G7, F4,
B6, B7, I9 (tags + guide), H16, H24-H28."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.fixed import GUIDE_COLUMNS, TAG_TAXONOMY
from ..functions.nulls import dedupe
from ..operators import catalog as cat
from ..operators import merge as M
from ..operators import resolve as R
from ..sources import ingest as I
from . import views as V
from .oracle_views import with_views
from .q_catalog import catalog_sql, CATALOG_CTES
from .q_ingest import FLAT_SQL, REPLY_SQL, flat
from .registry import query

A, B = V.PERSON_A, V.PERSON_B
G5 = GUIDE_COLUMNS

# ---------------------------------------------------------------- stand-in inputs


def cast_studio(t):
    d = t.documents
    return d.select(F.col("doc_id").alias("title_id"),
                    F.when(F.col("n_chars") % 3 == 0, F.lit(""))
                     .otherwise(F.concat_ws(", ", "lang", "source")).alias("actors_rt"),
                    F.col("source").alias("studio"), F.col("doc_id").alias("_ord"))


CAST_SQL = """SELECT doc_id AS title_id,
                     CASE WHEN n_chars % 3 = 0 THEN '' ELSE lang || ', ' || source END AS actors_rt,
                     source AS studio, doc_id AS _ord FROM documents"""


def guide(t):
    d, l = t.documents, t.labels
    q, x = F.col("quality"), F.col("toxic")
    return (d.join(l, "doc_id").select(
        F.col("doc_id").alias("title_id"),
        F.when(q == 1, "Mild").when(q == 0, "None").alias("sex_nudity"),
        F.when(x == 1, "Severe").when(x == 0, "none ").alias("violence_gore"),
        F.when((q == 1) & (x == 1), "Extreme").otherwise("Moderate").alias("profanity"),
        F.lit("mild").alias("alcohol_drugs"),
        F.when(F.col("lang") == "en", "").otherwise("Mild").alias("intensity")))


GUIDE_SQL = """SELECT d.doc_id AS title_id,
        CASE l.quality WHEN 1 THEN 'Mild' WHEN 0 THEN 'None' END AS sex_nudity,
        CASE l.toxic WHEN 1 THEN 'Severe' WHEN 0 THEN 'none ' END AS violence_gore,
        CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'Extreme' ELSE 'Moderate' END AS profanity,
        'mild' AS alcohol_drugs,
        CASE WHEN d.lang = 'en' THEN '' ELSE 'Mild' END AS intensity
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def guide_cached(t):
    d = t.documents
    lang = F.col("lang")
    return d.select(F.col("doc_id").alias("title_id"),
                    F.when(lang == "en", "None").otherwise("Mild").alias("sex_nudity"),
                    F.when(lang == "fr", "Moderate").otherwise("None").alias("violence_gore"),
                    F.lit("Mild").alias("profanity"),
                    F.when(lang == "de", "Severe").otherwise("None").alias("alcohol_drugs"),
                    F.lit("Moderate").alias("intensity"))


GUIDE_CACHED_SQL = """SELECT doc_id AS title_id,
        CASE WHEN lang = 'en' THEN 'None' ELSE 'Mild' END AS sex_nudity,
        CASE WHEN lang = 'fr' THEN 'Moderate' ELSE 'None' END AS violence_gore,
        'Mild' AS profanity,
        CASE WHEN lang = 'de' THEN 'Severe' ELSE 'None' END AS alcohol_drugs,
        'Moderate' AS intensity
    FROM documents"""

ORD_CASE = "CASE {c} WHEN 'None' THEN 0 WHEN 'Mild' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Severe' THEN 3 END"


# ---------------------------------------------------------------- C1, C3, C4, C5

@query("c1_join_cast_studio", with_views("""
    SELECT t.title_id, coalesce(c.actors_rt, '') AS actors_rt, coalesce(c.studio, '') AS studio_rt
    FROM title_info t LEFT JOIN cast_studio c ON t.title_id = c.title_id""",
    "title_info", extra={"cast_studio": CAST_SQL}))
def c1_join_cast_studio(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    out = M.join_cast_studio(V.title_info(t).select("title_id"), cast_studio(t))
    return out.select("title_id", "actors_rt", "studio_rt")


@query("c3_join_guide", with_views("SELECT t.title_id, " + ", ".join(
    f"coalesce({ORD_CASE.format(c='g.' + c)}, -1) AS pg_{c}" for c in G5) + """
    FROM title_info t LEFT JOIN guide g ON t.title_id = g.title_id""",
    "title_info", extra={"guide": GUIDE_SQL}))
def c3_join_guide(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    return M.join_guide(V.title_info(t).select("title_id"), guide(t))


@query("c4_pending", with_views("""
    SELECT t.title_id FROM title_info t
    WHERE NOT EXISTS (SELECT 1 FROM cast_studio c WHERE c.title_id = t.title_id
                      AND c.actors_rt IS NOT NULL AND trim(c.actors_rt) <> '')""",
    "title_info", extra={"cast_studio": CAST_SQL}))
def c4_pending(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    return M.pending(V.title_info(t).select("title_id"), cast_studio(t), result_col="actors_rt")


@query("c5_retry_set", with_views("""
    SELECT t.title_id FROM title_info t
    WHERE EXISTS (SELECT 1 FROM cast_studio c WHERE c.title_id = t.title_id
                  AND (c.actors_rt IS NULL OR trim(c.actors_rt) = ''))""",
    "title_info", extra={"cast_studio": CAST_SQL}))
def c5_retry_set(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    return M.retry_set(V.title_info(t).select("title_id"), cast_studio(t), "actors_rt")


# ---------------------------------------------------------------- I9 tags, H26, C2

VALS = {c: vs for c, vs in TAG_TAXONOMY.items()}


def _pick(values, idx_col):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx_col + 1).cast("int"))


def tag_replies(t):
    """One model reply per part: fenced JSON with lists, a single string, an
    unknown category, a value outside the taxonomy and a three-value list."""
    p = t.part
    k, s = F.col("p_partkey"), F.col("p_size")
    sc = _pick(VALS["social_context"], k % 19)
    pc = _pick(VALS["pacing"], s % 15)
    v1 = _pick(VALS["vibes"], k % 21)
    v2 = _pick(VALS["vibes"], (k + 5) % 21)
    v3 = _pick(VALS["vibes"], (k + 9) % 21)
    body = F.concat(
        F.lit('{"social_context": ["'), sc, F.lit('", "Not A Tag"], "pacing": "'), pc,
        F.lit('", "mood": ["Happy"], "vibes": ["'), v1, F.lit('", "'), v2, F.lit('", "'), v3, F.lit('"]}'))
    reply = F.when(s % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return p.select(F.col("p_partkey").alias("title_id"), reply.alias("reply"))


def _sql_pick(cat_, expr):
    arr = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in VALS[cat_]) + "]"
    return f"{arr}[({expr}) + 1]"


TAG_REPLY_SQL = f"""
    SELECT p_partkey AS title_id,
      CASE WHEN p_size % 2 = 0 THEN '```json\n' || body || '\n```' ELSE body END AS reply
    FROM (SELECT p_partkey, p_size,
            '{{"social_context": ["' || {_sql_pick('social_context', 'p_partkey % 19')} ||
            '", "Not A Tag"], "pacing": "' || {_sql_pick('pacing', 'p_size % 15')} ||
            '", "mood": ["Happy"], "vibes": ["' || {_sql_pick('vibes', 'p_partkey % 21')} ||
            '", "' || {_sql_pick('vibes', '(p_partkey + 5) % 21')} ||
            '", "' || {_sql_pick('vibes', '(p_partkey + 9) % 21')} || '"]}}' AS body
          FROM part)"""

TAXONOMY_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('" + c + "', '" + v.replace("'", "''") + "')" for c, vs in TAG_TAXONOMY.items() for v in vs
) + ") t(category, value)"

TAGS_LONG_SQL = """
    SELECT title_id, category, value FROM (
      SELECT title_id, category, value,
             row_number() OVER (PARTITION BY title_id, category ORDER BY i) AS rn
      FROM (
        SELECT title_id, category, v.value, v.i
        FROM (
          SELECT title_id, k AS category,
                 CASE WHEN json_type(j, '$."' || k || '"') = 'ARRAY'
                      THEN from_json(json_extract(j, '$."' || k || '"'), '["VARCHAR"]')
                      ELSE [json_extract_string(j, '$."' || k || '"')] END AS vals
          FROM (SELECT title_id, j, unnest(json_keys(j)) AS k FROM (
                  SELECT title_id, CAST(CASE WHEN starts_with(b, 'json') THEN substr(b, 5) ELSE b END AS JSON) AS j
                  FROM (SELECT title_id,
                               CASE WHEN starts_with(trim(reply), '```')
                                    THEN string_split(trim(reply), '```')[2] ELSE trim(reply) END AS b
                        FROM tag_replies)))) x,
             unnest(list_transform(vals, lambda v, i: {'value': v, 'i': i})) AS u(v)) y
      WHERE EXISTS (SELECT 1 FROM taxonomy t WHERE t.category = y.category AND t.value = y.value))
    WHERE rn <= 2"""

TAG_CTES = {"tag_replies": TAG_REPLY_SQL, "taxonomy": TAXONOMY_SQL, "tags_long": TAGS_LONG_SQL}


def tags_long(spark, t):
    return I.ingest_tag_replies(tag_replies(t), I.taxonomy(spark))


@query("i9_ingest_tag_replies", with_views("SELECT title_id, category, value FROM tags_long",
                                           extra=TAG_CTES))
def i9_ingest_tag_replies(spark, sf_dir):
    return tags_long(spark, V.Tables(spark, sf_dir))


TAG_COLS = [P.tag_column_name_py(c, v) for c, vs in TAG_TAXONOMY.items() for v in vs]


def _sql_tag_col(c, v):
    return ("'tag_' || '" + c + "' || '_' || '" +
            v.replace("&", "and").replace("/", "_").replace(" ", "_").replace("-", "_").replace("'", "''") + "'")


@query("c2_join_tags", with_views(
    "SELECT t.title_id, " + ", ".join(
        f"CAST(coalesce(max(CASE WHEN g.category = '{c}' AND g.value = '{v.replace(chr(39), chr(39) * 2)}' "
        f"THEN 1 END), 0) AS INTEGER) AS \"{P.tag_column_name_py(c, v)}\""
        for c, vs in TAG_TAXONOMY.items() for v in vs) +
    " FROM title_info t LEFT JOIN tags_long g ON t.title_id = g.title_id GROUP BY t.title_id",
    "title_info", extra=TAG_CTES))
def c2_join_tags(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    tl = tags_long(spark, t).select("title_id", P.tag_column_name("category", "value").alias("column"))
    out = M.join_tags(V.title_info(t).select("title_id"), tl, TAG_COLS)
    return out.select("title_id", *[F.col(f"`{c}`").cast("int").alias(c) for c in TAG_COLS])


# ---------------------------------------------------------------- I9 guide, H27, B7

def guide_candidates(t):
    page = guide(t).withColumn("src", F.lit("page"))
    model_a = guide_cached(t).filter(F.col("title_id") % 2 == 0).withColumn("src", F.lit("model_a"))
    model_b = guide_cached(t).withColumn("src", F.lit("model_b")) \
                             .withColumn("intensity", F.lit("Extreme"))
    return page.unionByName(model_a).unionByName(model_b)


CAND_SQL = f"""
    SELECT *, 'page' AS src FROM ({GUIDE_SQL})
    UNION ALL SELECT *, 'model_a' AS src FROM ({GUIDE_CACHED_SQL}) WHERE title_id % 2 = 0
    UNION ALL SELECT title_id, sex_nudity, violence_gore, profanity, alcohol_drugs, 'Extreme' AS intensity,
                     'model_b' AS src FROM ({GUIDE_CACHED_SQL})"""

SEV_CLEAN = ("CASE WHEN {f} IN ('None', 'Mild', 'Moderate', 'Severe') THEN {f} END")
INITCAP = "upper(substr(trim({c}), 1, 1)) || lower(substr(trim({c}), 2))"


@query("i9_ingest_guide_replies", with_views("""
    SELECT title_id, src, """ + ", ".join(f"{c}" for c in G5) + """ FROM (
      SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY
               CASE src WHEN 'page' THEN 1 WHEN 'model_a' THEN 2 WHEN 'model_b' THEN 3 END) AS rn
      FROM (SELECT title_id, src, """ + ", ".join(
        SEV_CLEAN.format(f=INITCAP.format(c=c)) + f" AS {c}" for c in G5) + """ FROM cand)
      WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in G5) + """)
    WHERE rn = 1""", extra={"cand": CAND_SQL}))
def i9_ingest_guide_replies(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    valid = I.validate_guide(guide_candidates(t))
    out = I.prefer_sources(valid, "title_id", "src", ["page", "model_a", "model_b"])
    return out.select("title_id", "src", *G5)


@query("b7_needs_work", with_views("""
    SELECT t.title_id,
           (f.writer IS NULL OR trim(f.writer) IN ('', 'N/A')) AS needs_writer,
           coalesce(""" + " AND ".join(
        SEV_CLEAN.format(f=INITCAP.format(c="g." + c)) + " IS NOT NULL" for c in G5) + """, false) AS guide_complete,
           EXISTS (SELECT 1 FROM tags_long x WHERE x.title_id = t.title_id) AS has_tags
    FROM title_info t LEFT JOIN flat f ON t.title_id = f.title_id
    LEFT JOIN guide g ON t.title_id = g.title_id""",
    "title_info", extra={"replies": REPLY_SQL, "flat": FLAT_SQL, "guide": GUIDE_SQL, **TAG_CTES}))
def b7_needs_work(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    f = flat(spark, sf_dir).select("title_id", "writer")
    g = guide(t).select("title_id", *[P.clean_severity(c).alias(c) for c in G5])
    has = tags_long(spark, t).select("title_id").distinct().withColumn("has_tags", F.lit(True))
    complete = F.lit(True)
    for c in G5:
        complete = complete & F.col(c).isNotNull()
    return (V.title_info(t).select("title_id")
            .join(f, "title_id", "left").join(g, "title_id", "left").join(has, "title_id", "left")
            .select("title_id",
                    (F.col("writer").isNull() | F.trim("writer").isin("", "N/A")).alias("needs_writer"),
                    F.coalesce(complete, F.lit(False)).alias("guide_complete"),
                    F.coalesce("has_tags", F.lit(False)).alias("has_tags")))


# ---------------------------------------------------------------- C11, C8

def search_queries(t):
    p = t.part
    s, n = F.col("p_size"), F.col("p_name")
    q = (F.when(s % 4 == 0, n).when(s % 4 == 1, F.replace(n, F.lit(" "), F.lit("")))
          .when(s % 4 == 2, F.concat(n, F.lit("!"))).otherwise(F.replace(n, F.lit(" "), F.lit("-"))))
    return p.select(F.col("p_partkey").alias("query_id"), q.alias("query"))


QUERIES_SQL = """SELECT p_partkey AS query_id,
    CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '')
                    WHEN 2 THEN p_name || '!' ELSE replace(p_name, ' ', '-') END AS query
    FROM part"""

NORM_SQL = "trim(regexp_replace(regexp_replace(regexp_replace({q}, '([A-Za-z])[''‘’`]([A-Za-z])', '\\1\\2', 'g'), '[-,!?.;:]+', ' ', 'g'), '\\s+', ' ', 'g'))"

C11_CTES = {
    "queries": QUERIES_SQL,
    "qn": f"SELECT query_id, query, {NORM_SQL.format(q='query')} AS norm FROM queries",
    "qb": "SELECT query_id, query, norm, CASE WHEN norm <> '' THEN norm ELSE query END AS base FROM qn",
    "words": """SELECT query_id, base, w FROM (SELECT query_id, base, unnest(string_split(base, ' ')) AS w FROM qb)
                WHERE length(w) > 5 AND regexp_matches(w, '^[A-Za-z]+$')""",
    "variants": """
        SELECT query_id, query AS variant, 0 AS rank FROM qb
        UNION ALL SELECT query_id, norm, 1 FROM qb WHERE norm <> query
        UNION ALL SELECT query_id,
               substr(base, 1, instr(base, w) - 1) || substr(w, 1, pos) || ' ' || substr(w, pos + 1)
               || substr(base, instr(base, w) + length(w)) AS variant, 2
        FROM (SELECT query_id, base, w, unnest(range(greatest(3, length(w) - 4), length(w) - 2)) AS pos FROM words)""",
    "keys": "SELECT title_id, lower(title) AS k FROM catalog_base",
    "hits": """SELECT v.query_id, k.title_id, min(v.rank) AS rank
        FROM variants v JOIN keys k ON lower(v.variant) = k.k GROUP BY v.query_id, k.title_id""",
}


def resolved(spark, sf_dir, first=None):
    t = V.Tables(spark, sf_dir)
    return R.resolve_titles(search_queries(t), V.catalog_base(t), first=first)


@query("c11_resolve_titles", with_views("SELECT query_id, title_id, CAST(rank AS INTEGER) AS rank FROM hits",
                                        "catalog_base", extra=C11_CTES))
def c11_resolve_titles(spark, sf_dir):
    return resolved(spark, sf_dir).select("query_id", "title_id", F.col("rank").cast("int"))


@query("c8_attach_scores", with_views("""
    SELECT h.query_id, h.title_id, h.rank, s.user_id, s.pct FROM (
        SELECT query_id, title_id, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, title_id) AS rn FROM hits)
        WHERE rn <= 10) h
    LEFT JOIN scores s ON h.title_id = s.title_id""",
    "rated", "seen", "listing", "catalog_base", extra={**CATALOG_CTES, **C11_CTES}))
def c8_attach_scores(spark, sf_dir):
    """Scores of everyone who has one for the title."""
    t = V.Tables(spark, sf_dir)
    hits = resolved(spark, sf_dir, first=10).select("query_id", "title_id", F.col("rank").cast("int"))
    return M.attach_scores_to_hits(hits, cat.person_scores(V.rated(t)).select("title_id", "user_id", "pct"), n=10)


# ---------------------------------------------------------------- C12, G4, G5

def services_df(t):
    return cat.first_service(V.listing(t))


def cache_table(t):
    d = t.documents
    return d.select(F.col("doc_id").alias("title_id"),
                    F.when(F.col("n_chars") % 4 == 0, None).otherwise(F.col("n_chars")).alias("box_office"))


CACHE_SQL = "SELECT doc_id AS title_id, CASE WHEN n_chars % 4 = 0 THEN NULL ELSE n_chars END AS box_office FROM documents"


@query("c12_reuse_or_refetch", catalog_sql("""
    SELECT s.title_id, s.service,
           CASE WHEN c.title_id IS NULL THEN 'new' WHEN c.box_office IS NULL THEN 'refresh' ELSE 'reuse' END AS status,
           CASE WHEN c.title_id IS NULL THEN 1 WHEN c.box_office IS NULL THEN 0 ELSE 2 END AS priority
    FROM services s LEFT JOIN cache c ON s.title_id = c.title_id""").replace(
        "WITH ", "WITH cache AS (" + CACHE_SQL + "),\n", 1))
def c12_reuse_or_refetch(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    out = M.reuse_or_refetch(services_df(t), cache_table(t), ["box_office"])
    return out.select("title_id", "service", "status", "priority")


CURRENT_SQL = "SELECT title_id FROM services WHERE service <> 'AFRICA'"


def current_ids(t):
    return services_df(t).filter(F.col("service") != "AFRICA").select("title_id")


def old_new(t):
    old = V.catalog_base(t).select("title_id", "title", "imdb_score")
    new = (V.catalog_base(t).filter(F.col("runtime") > 40)
           .select("title_id", F.upper("title").alias("title"), (F.col("imdb_score") + 1).alias("imdb_score")))
    return old, new


@query("g4_merge_catalog", catalog_sql(f"""
    SELECT o.title_id, o.title, o.imdb_score FROM catalog_base o
    WHERE o.title_id NOT IN (SELECT title_id FROM catalog_base WHERE runtime > 40)
      AND o.title_id IN ({CURRENT_SQL})
    UNION ALL
    SELECT title_id, upper(title), imdb_score + 1 FROM catalog_base WHERE runtime > 40"""))
def g4_merge_catalog(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    old, new = old_new(t)
    return M.merge_catalog(old, new, current_ids(t), keep_unlisted=False)


@query("g5_removed_titles", catalog_sql(f"""
    SELECT DISTINCT title_id FROM catalog_base WHERE title_id NOT IN ({CURRENT_SQL})"""))
def g5_removed_titles(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    return M.removed_titles(V.catalog_base(t), current_ids(t))


# ---------------------------------------------------------------- C13, H16

SLUG_SQL = ("rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[''‘’]', '', 'g'), "
            "'[^a-z0-9 ]', '_', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '_')")


def landed_pages(t):
    li = t.lineitem.select("l_partkey", "l_linenumber", "l_shipdate")
    p = t.part.select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    sl = P.slug(F.col("p_name"))
    y = F.year("l_shipdate")
    return j.select(
        F.when(F.col("l_linenumber") % 2 == 0, sl).otherwise(F.concat_ws("_", sl, y.cast("string")))
         .alias("page_slug"),
        y.alias("page_year"),
        F.when(F.col("l_linenumber") == 5, F.lit("")).otherwise(F.lit("x")).alias("cast"))


@query("c13_match_pages", with_views(f"""
    , pages_l AS (
      SELECT DISTINCT CASE WHEN l.l_linenumber % 2 = 0 THEN {SLUG_SQL.format(c='p.p_name')}
                           ELSE {SLUG_SQL.format(c='p.p_name')} || '_' || CAST(year(l.l_shipdate) AS VARCHAR) END AS page_slug,
             CAST(year(l.l_shipdate) AS INTEGER) AS page_year
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber <> 5),
    cands AS (
      SELECT t.title_id, t.year, c.page_slug, c.pref, c.page_year
      FROM catalog_base t,
           LATERAL (SELECT {SLUG_SQL.format(c='t.title')} AS page_slug, 0 AS pref
                    UNION ALL SELECT {SLUG_SQL.format(c='t.title')} || '_' || CAST(t.year AS VARCHAR), 1) s0,
           LATERAL (SELECT s0.page_slug, s0.pref, t.year + d AS page_year FROM range(-1, 2) r(d)) c
      WHERE t.year IS NOT NULL)
    SELECT title_id, page_slug, page_year, pref FROM (
      SELECT c.title_id, c.page_slug, c.page_year, c.pref,
             row_number() OVER (PARTITION BY c.title_id
                                ORDER BY c.pref, abs(c.page_year - c.year), c.page_year) AS rn
      FROM cands c JOIN pages_l p ON c.page_slug = p.page_slug AND c.page_year = p.page_year)
    WHERE rn = 1""", "catalog_base"))
def c13_match_pages(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    titles = V.catalog_base(t).filter(F.col("year").isNotNull())
    return R.match_pages_by_slug_year(titles, landed_pages(t))


@query("h16_slug", f"SELECT p_partkey AS title_id, {SLUG_SQL.format(c='p_name || ' + chr(39) + ': It' + chr(39) + chr(39) + 's  Back!' + chr(39))} AS slug FROM part")
def h16_slug(spark, sf_dir):
    p = V.Tables(spark, sf_dir).part
    return p.select(F.col("p_partkey").alias("title_id"),
                    P.slug(F.concat(F.col("p_name"), F.lit(": It's  Back!"))).alias("slug"))


# ---------------------------------------------------------------- C14, C15

def audience(t):
    """Latest audience score per title from the events stream (title = event user)."""
    ev = I.explode_score_map(t.events, "props", keep=("user_id", "ts", "event_id"))
    latest = dedupe(ev.select(F.col("user_id").alias("title_id"), "ts", "event_id",
                              F.col("score").alias("audience_score")),
                    "title_id", [F.col("ts"), F.col("event_id")], keep="last")
    return latest.select("title_id", "audience_score")


@query("c14_attach_audience_awards", with_views("""
    , aud AS (SELECT title_id, audience_score FROM (
        SELECT e.user_id AS title_id, CAST(j.value AS INTEGER) AS audience_score,
               row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rn
        FROM events e, json_each(e.props) j) WHERE rn = 1)
    SELECT t.title_id, a.audience_score,
           coalesce(CAST(f.oscar_win AS INTEGER), 0) AS oscar_wins,
           coalesce(CAST(f.oscar_nom AS INTEGER), 0) AS oscar_noms,
           coalesce(CAST(f.award_wins AS INTEGER), 0) AS gg_wins,
           coalesce(CAST(f.award_noms AS INTEGER), 0) AS gg_noms
    FROM title_info t LEFT JOIN aud a ON t.title_id = a.title_id
    LEFT JOIN flat f ON t.title_id = f.title_id""", "title_info",
    extra={"replies": REPLY_SQL, "flat": FLAT_SQL}))
def c14_attach_audience_awards(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    aw = flat(spark, sf_dir).select(
        "title_id", F.col("oscar_win").cast("int").alias("oscar_wins"),
        F.col("oscar_nom").cast("int").alias("oscar_noms"),
        F.col("award_wins").cast("int").alias("gg_wins"), F.col("award_noms").cast("int").alias("gg_noms"))
    return M.attach_audience_awards(V.title_info(t).select("title_id"), audience(t), aw)


@query("c15_guide_live_over_cache", with_views(
    "SELECT coalesce(l.title_id, c.title_id) AS title_id, " + ", ".join(
        f"CASE WHEN coalesce({', '.join('l.' + x for x in G5)}) IS NOT NULL THEN l.{c} ELSE c.{c} END AS {c}" for c in G5) +
    " FROM live l FULL JOIN cached c ON l.title_id = c.title_id",
    extra={"live": GUIDE_SQL, "cached": GUIDE_CACHED_SQL}))
def c15_guide_live_over_cache(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    return M.guide_live_over_cache(guide(t), guide_cached(t))


# ---------------------------------------------------------------- G1, G2, G3, G6, G7

@query("g1_union_titles", with_views(f"""
    SELECT title_id, year, src FROM (
      SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY src, l_orderkey, l_linenumber) AS rn FROM (
        SELECT title_id, coalesce(TRY_CAST(nullif(regexp_extract(CAST(year AS VARCHAR), '(\\d{{4}})', 1), '') AS INTEGER), 2000) AS year,
               CASE user_id WHEN '{A}' THEN 0 ELSE 1 END AS src, l_orderkey, l_linenumber
        FROM history WHERE user_id IN ('{A}', '{B}')))
    WHERE rn = 1""", "history"))
def g1_union_titles(spark, sf_dir):
    h = V.history(V.Tables(spark, sf_dir))
    def person(u):
        return h.filter(F.col("user_id") == u).select(
            "title_id", P.clean_year("year").alias("year"),
            F.struct("l_orderkey", "l_linenumber").alias("_ord"))
    out = M.union_titles([person(A), person(B)], source_col="src")
    return out.select("title_id", "year", "src")


def chunks(t):
    l = t.labels
    c0 = l.filter(F.col("quality") == 1).select(
        F.col("doc_id").alias("title_id"), F.concat(F.lit("Q, "), F.col("doc_id").cast("string")).alias("actors_rt"),
        F.lit("chunk0").alias("studio"), F.col("doc_id").alias("_ord"))
    c1 = l.filter(F.col("toxic") == 1).select(
        F.col("doc_id").alias("title_id"), F.lit("").alias("actors_rt"),
        F.lit("chunk1").alias("studio"), F.col("doc_id").alias("_ord"))
    return c0, c1


CHUNK_SQL = {
    "c0": "SELECT doc_id AS title_id, 'Q, ' || CAST(doc_id AS VARCHAR) AS actors_rt, 'chunk0' AS studio, doc_id AS _ord FROM labels WHERE quality = 1",
    "c1": "SELECT doc_id AS title_id, '' AS actors_rt, 'chunk1' AS studio, doc_id AS _ord FROM labels WHERE toxic = 1",
}


@query("g2_merge_keep_last", with_views("""
    SELECT title_id, actors_rt, studio FROM (
      SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY src DESC, _ord DESC) AS rn FROM (
        SELECT *, 0 AS src FROM cast_studio UNION ALL SELECT *, 1 FROM c0 UNION ALL SELECT *, 2 FROM c1))
    WHERE rn = 1""", extra={"cast_studio": CAST_SQL, **CHUNK_SQL}))
def g2_merge_keep_last(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    c0, c1 = chunks(t)
    return M.merge_keep_last(cast_studio(t), [c0, c1]).select("title_id", "actors_rt", "studio")


@query("g3_upsert_non_blank", with_views("""
    SELECT coalesce(b.title_id, u.title_id) AS title_id,
           CASE WHEN u.title_id IS NOT NULL THEN u.actors_rt ELSE b.actors_rt END AS actors_rt,
           CASE WHEN u.title_id IS NOT NULL THEN u.studio ELSE b.studio END AS studio,
           coalesce(u.title_id IS NOT NULL AND (b.actors_rt IS NULL OR trim(b.actors_rt) = ''), false) AS rescued
    FROM cast_studio b FULL JOIN (
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY pass DESC) AS rn FROM (
            SELECT *, 0 AS pass FROM c0 UNION ALL SELECT *, 2 FROM c1
            UNION ALL SELECT title_id, actors_rt, 'again', _ord, 1 FROM c0 WHERE title_id % 3 = 0)
          WHERE actors_rt IS NOT NULL AND trim(actors_rt) <> '') WHERE rn = 1) u ON b.title_id = u.title_id""",
    extra={"cast_studio": CAST_SQL, **CHUNK_SQL}))
def g3_upsert_non_blank(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    c0, c1 = chunks(t)
    base = cast_studio(t).drop("_ord")
    again = c0.filter(F.col("title_id") % 3 == 0).withColumn("studio", F.lit("again"))    # repeated updates
    upd = (c0.withColumn("pass", F.lit(0)).unionByName(again.withColumn("pass", F.lit(1)))
             .unionByName(c1.withColumn("pass", F.lit(2))).drop("_ord"))
    return M.upsert_non_blank(base, upd, "actors_rt", order="pass").select("title_id", "actors_rt", "studio", "rescued")


@query("g6_append_if_absent", with_views("""
    SELECT title_id, sex_nudity, 'live' AS origin FROM live
    UNION ALL SELECT title_id, CASE WHEN title_id % 3 = 0 THEN 'first' ELSE sex_nudity END, 'cached' FROM cached c
    WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.title_id = c.title_id)""",
    extra={"live": GUIDE_SQL, "cached": GUIDE_CACHED_SQL}))
def g6_append_if_absent(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    live = guide(t).select("title_id", "sex_nudity", F.lit("live").alias("origin"))
    cached = guide_cached(t).select("title_id", "sex_nudity", F.lit("cached").alias("origin"))
    first = cached.filter(F.col("title_id") % 3 == 0).withColumn("sex_nudity", F.lit("first"))   # repeated new ids
    rows = cached.withColumn("pass", F.lit(1)).unionByName(first.withColumn("pass", F.lit(0)))
    return M.append_if_absent(live, rows, order="pass")


@query("g7_incremental_append_dedupe", with_views("""
    SELECT title_id, title, runtime FROM (
      SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY src, title_id) AS rn FROM (
        SELECT title_id, title, runtime, 0 AS src FROM flat WHERE runtime IS NULL OR runtime <= 90
        UNION ALL SELECT title_id, upper(title), runtime, 1 FROM flat WHERE runtime > 60))
    WHERE rn = 1""", extra={"replies": REPLY_SQL, "flat": FLAT_SQL}))
def g7_incremental_append_dedupe(spark, sf_dir):
    f = flat(spark, sf_dir)
    done = f.filter(F.col("runtime").isNull() | (F.col("runtime") <= 90)).select(
        "title_id", "title", "runtime", F.col("title_id").alias("_ord"))
    new = f.filter(F.col("runtime") > 60).select(
        "title_id", F.upper("title").alias("title"), "runtime", F.col("title_id").alias("_ord"))
    return M.incremental_append_dedupe(done, new).select("title_id", "title", "runtime")


# ---------------------------------------------------------------- F4, H24, B6

@query("f4_quota_per_service", catalog_sql("""
    SELECT title_id, service FROM (
      SELECT title_id, service, row_number() OVER (PARTITION BY service ORDER BY title_id) AS rn
      FROM services) WHERE rn <= 50"""))
def f4_quota_per_service(spark, sf_dir):
    return M.quota_per_group(services_df(V.Tables(spark, sf_dir)), "service", [F.col("title_id")], 50)


@query("f4_daily_budget", with_views("""
    SELECT t.title_id FROM title_info t
    WHERE NOT EXISTS (SELECT 1 FROM cast_studio c WHERE c.title_id = t.title_id
                      AND c.actors_rt IS NOT NULL AND trim(c.actors_rt) <> '')
    ORDER BY t.title_id LIMIT 100""", "title_info", extra={"cast_studio": CAST_SQL}))
def f4_daily_budget(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    todo = M.pending(V.title_info(t).select("title_id"), cast_studio(t), result_col="actors_rt")
    return M.quota(todo, [F.col("title_id")], 100)


# Provider names that exercise the service-key rules.
PROVIDERS = ["Netflix", "HBO Max", "Amazon Prime Video", "Disney Plus", "Hulu", "Apple TV+",
             "Peacock", "Paramount Plus", "Starz", "Hulu Live TV", "Prime Video Channel", "MAX",
             "Disney+", "Showmax", "Paramount+ Amazon Channel", "Pluto TV"]


H24_SQL = ("SELECT s_suppkey, provider, " + """
    CASE WHEN contains(n, 'netflix') THEN 'netflix'
         WHEN n IN ('max', 'hbo max') OR (contains(n, 'max') AND NOT contains(n, 'starz') AND NOT contains(n, 'showmax')
              AND NOT contains(n, 'amazon') AND NOT contains(n, 'paramount')) THEN 'max'
         WHEN (contains(n, 'prime video') OR (contains(n, 'amazon') AND contains(n, 'prime'))) AND NOT contains(n, 'channel') THEN 'prime'
         WHEN contains(n, 'disney') AND contains(n, 'plus') THEN 'disney'
         WHEN contains(n, 'disney+') THEN 'disney'
         WHEN n = 'hulu' OR (contains(n, 'hulu') AND NOT contains(n, 'live')) THEN 'hulu'
         WHEN contains(replace(n, ' ', ''), 'appletv+') OR (contains(n, 'apple') AND contains(n, 'tv') AND contains(n, '+')) THEN 'apple'
         WHEN contains(n, 'peacock') THEN 'peacock'
         WHEN contains(n, 'paramount') AND (contains(n, 'plus') OR contains(n, '+')) THEN 'paramount'
    END AS service_key
    FROM (SELECT s_suppkey, provider, lower(trim(provider)) AS n FROM (
        SELECT s_suppkey, """ + "[" + ", ".join("'" + p + "'" for p in PROVIDERS) + """][s_suppkey % 16 + 1] AS provider
        FROM supplier))""")


@query("h24_service_key", H24_SQL)
def h24_service_key(spark, sf_dir):
    """H24 on one provider name per supplier (the name list is fixed, the rows grow)."""
    sup = V.Tables(spark, sf_dir).supplier
    prov = F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), (F.col("s_suppkey") % 16 + 1).cast("int"))
    return sup.select("s_suppkey", prov.alias("provider")).withColumn("service_key", P.service_key("provider"))


@query("b6_title_details", with_views("""
    SELECT t.title_id, t.title,
           list_filter(list_transform(string_split(coalesce(f.actors, ''), ','), lambda x: trim(x)),
                       lambda x: x NOT IN ('', 'N/A')) AS cast_list,
           CAST(f.rt_score AS INTEGER) AS rt_int, CAST(f.metascore AS INTEGER) AS meta_int,
           """ + ", ".join(f"coalesce({ORD_CASE.format(c='g.' + c)}, 0) AS {c}" for c in G5) + """
    FROM title_info t LEFT JOIN flat f ON t.title_id = f.title_id
    LEFT JOIN guide g ON t.title_id = g.title_id""", "title_info",
    extra={"replies": REPLY_SQL, "flat": FLAT_SQL, "guide": GUIDE_SQL}))
def b6_title_details(spark, sf_dir):
    t = V.Tables(spark, sf_dir)
    f = flat(spark, sf_dir)
    g = guide(t)
    j = V.title_info(t).select("title_id", "title").join(f.drop("title"), "title_id", "left") \
        .join(g, "title_id", "left")
    from ..functions.nulls import split_list
    return j.select("title_id", "title", split_list("actors").alias("cast_list"),
                    F.col("rt_score").cast("int").alias("rt_int"),
                    F.col("metascore").cast("int").alias("meta_int"),
                    *[P.severity_ordinal(F.col(c), 0).alias(c) for c in G5])


# ---------------------------------------------------------------- E2

@query("e2_dedupe_keep_first", with_views("""
    SELECT user_id, title_id, rating, l_orderkey, l_linenumber FROM history""", "history"))
def e2_dedupe_keep_first(spark, sf_dir):
    r = V.rated(V.Tables(spark, sf_dir))
    return dedupe(r, ["user_id", "title_id"], V.RATED_ORDER, keep="first").select(
        "user_id", "title_id", "rating", "l_orderkey", "l_linenumber")


@query("e2_dedupe_keep_last", with_views("""
    SELECT user_id, title_id, rating, l_orderkey, l_linenumber FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, title_id
          ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
      FROM rated) WHERE rn = 1""", "rated"))
def e2_dedupe_keep_last(spark, sf_dir):
    r = V.rated(V.Tables(spark, sf_dir))
    return dedupe(r, ["user_id", "title_id"], V.RATED_ORDER, keep="last").select(
        "user_id", "title_id", "rating", "l_orderkey", "l_linenumber")
