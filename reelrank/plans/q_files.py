"""Files written and read back: guide CSV (A3), catalog versions (A4), seen ids
(A5), and pages whose entities lie in embedded JSON (A7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources import ingest as I
from ..sources import sinks
from . import views as V
from .oracle_views import with_views
from .q_catalog import catalog, catalog_sql
from .q_ingest import FLAT_SQL, REPLY_SQL, flat
from .q_merge import G5, GUIDE_SQL, guide
from .registry import query

A, B = V.PERSON_A, V.PERSON_B


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a3_guide_csv", f"SELECT title_id, {', '.join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in G5)} FROM ({GUIDE_SQL})")
def a3_guide_csv(spark, sf_dir):
    """The guide as CSV: only a blank cell is null, the text None stays."""
    path = _folder(spark, "guide")
    (guide(V.Tables(spark, sf_dir)).select("title_id", *G5).write.option("header", True).option("nullValue", "")
     .option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path))
    schema = T.StructType([T.StructField("title_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in G5)])
    return I.read_csv_table(spark, path, schema, ["title_id", *G5])


@query("a4_catalog_versions", catalog_sql("SELECT title_id, service, type, year, a_seen, b_seen FROM catalog"))
def a4_catalog_versions(spark, sf_dir):
    """Two versions of the catalog; the newest is read."""
    path = _folder(spark, "catalog")
    rows = catalog(spark, sf_dir).select("title_id", "service", "type", "year", "a_seen", "b_seen")
    sinks.write_catalog(rows.where("not a_seen"), path)
    sinks.write_catalog(rows, path)
    return sinks.read_catalog(spark, path)


@query("a5_seen_files", with_views(f"""
    SELECT DISTINCT user_id, CAST(title_id AS VARCHAR) AS title_id FROM seen WHERE user_id IN ('{A}', '{B}')""", "rated", "seen"))
def a5_seen_files(spark, sf_dir):
    """The pair's seen ids as JSON objects of two id lists, a file for about a
    thousand titles."""
    path, keys = _folder(spark, "seen"), {"a_seen": A, "b_seen": B}
    seen = V.seen(V.Tables(spark, sf_dir)).where(F.col("user_id").isin(A, B)).withColumn("part", F.floor(F.col("title_id") / 1000))
    (seen.groupBy("part").agg(*(F.collect_list(F.when(F.col("user_id") == u, F.col("title_id").cast("string"))).alias(k)
                                for k, u in keys.items()))
     .write.partitionBy("part").json(path))
    return I.read_seen(spark, path, keys)


LEVELS = ("sex_nudity", "violence_gore")


@query("a7_embedded_entities", with_views(f"""
    SELECT t.title_id AS page_id, t.title, 'en' AS lang,
           array_to_string(list_filter(list_transform(string_split(coalesce(f.actors, ''), ','), lambda x: trim(x)),
                                       lambda x: x <> ''), '|') AS "cast",
           coalesce(CAST(f.year AS VARCHAR), '') AS year, t.studio,
           array_to_string(list_filter(list_transform(string_split(coalesce(f.genre, ''), ','), lambda x: trim(x)),
                                       lambda x: x <> ''), '|') AS genres,
           {" || '|' || ".join(f"'{c}=' || coalesce(g.{c}, '-')" for c in LEVELS)} AS severities
    FROM title_info t LEFT JOIN flat f ON f.title_id = t.title_id LEFT JOIN guide g ON g.title_id = t.title_id""",
    "title_info", extra={"replies": REPLY_SQL, "flat": FLAT_SQL, "guide": GUIDE_SQL}))
def a7_embedded_entities(spark, sf_dir):
    """Pages with a title's entities in ``ld+json`` and ``__NEXT_DATA__``
    blocks, every third studio in a ``<dt>/<dd>`` pair instead, read back."""
    t = V.Tables(spark, sf_dir)

    def items(c):
        return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    f = flat(spark, sf_dir).select("title_id", items("actors").alias("actors"), "year", items("genre").alias("genres"))
    rows = (V.title_info(t).select("title_id", "title", "studio").join(f, "title_id", "left")
            .join(guide(t).select("title_id", *LEVELS), "title_id", "left"))
    in_pair = F.col("title_id") % 3 == 0
    ld = F.to_json(F.struct(
        F.transform("actors", lambda a: F.struct(a.alias("name"))).alias("actor"),
        F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("dateCreated"),
        F.when(~in_pair, F.struct(F.col("studio").alias("name"))).alias("productionCompany"), F.col("genres").alias("genre")))
    levels = F.array(*(F.struct(F.lit(c).alias("id"), F.col(c).alias("severity")) for c in LEVELS))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(levels.alias("categories")).alias("contentData")).alias("pageProps"))
                              .alias("props")))
    html = F.concat(F.lit('<html lang="en"><head><title>'), "title", F.lit('</title><script type="application/ld+json">'), ld,
                    F.lit('</script><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></head>"),
                    F.when(in_pair, F.concat(F.lit("<dl><dt>Studio</dt> <dd>"), "studio", F.lit("</dd></dl>"))).otherwise(F.lit("")),
                    F.lit("</html>"))
    out = I.extract_page_entities(rows.select(F.col("title_id").alias("page_id"), html.alias("html")))
    said = F.transform("severities", lambda s: F.concat(s["id"], F.lit("="), F.coalesce(s["severity"], F.lit("-"))))
    return out.select("page_id", "title", "lang", F.coalesce(F.array_join("cast", "|"), F.lit("")).alias("cast"), "year", "studio",
                      F.coalesce(F.array_join("genres", "|"), F.lit("")).alias("genres"), F.array_join(said, "|").alias("severities"))
