"""Sources: ratings, metadata replies, seen lists, score maps, landed pages,
id extraction and reply ingestion (A1-A8, I9).

Readers take explicit schemas (no inference on the hot path) and return
DataFrames; parsing is Catalyst expressions (``from_json``, regex), no UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse as P
from ..functions.fixed import GUIDE_COLUMNS, TAG_TAXONOMY
from ..functions.nulls import dedupe

RATINGS_SCHEMA = T.StructType([
    T.StructField("Const", T.StringType()), T.StructField("Your Rating", T.StringType()),
    T.StructField("Title", T.StringType())])

METADATA_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "Title", "Year", "Rated", "Runtime", "Genre", "Director", "Actors", "Writer", "Plot",
        "Language", "Country", "Awards", "imdbRating", "imdbVotes", "Metascore", "BoxOffice",
        "Poster", "Type", "imdbID", "Production", "Response")],
    T.StructField("Ratings", T.ArrayType(T.StructType([
        T.StructField("Source", T.StringType()), T.StructField("Value", T.StringType())]))),
])


# ---------------------------------------------------------------- A1

def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan of one person's exported ratings, explicit schema, input order kept."""
    return (spark.read.option("header", True).schema(RATINGS_SCHEMA).csv(path)
                 .withColumn("_ord", F.monotonically_increasing_id()))


def ingest_ratings(raw: DataFrame, id_col="Const", rating_col="Your Rating", title_col="Title",
                   order_col="_ord", by=("user_id",)) -> DataFrame:
    """A1: project id/rating/title, drop rows lacking id or rating, cast the
    rating to double, keep the first row per (person, id)."""
    df = raw.select(*by, F.col(id_col).alias("title_id"),
                    F.col(rating_col).cast("string").try_cast("double").alias("rating"),
                    F.col(title_col).alias("title"), F.col(order_col).alias("_ord"))
    df = df.filter(F.col("title_id").isNotNull() & F.col("rating").isNotNull())
    return dedupe(df, [*by, "title_id"], "_ord", keep="first").drop("_ord")


# ---------------------------------------------------------------- A2

def flatten_metadata(replies: DataFrame, json_col: str = "reply", keep=()) -> DataFrame:
    """A2: JSON metadata replies -> typed flat columns; ``Response = "False"`` dropped."""
    j = F.from_json(F.col(json_col), METADATA_SCHEMA)
    df = replies.select(*keep, j.alias("r")).filter(F.coalesce(F.col("r.Response"), F.lit("True")) != "False")
    r = lambda c: F.col("r." + c)
    awards = P.award_columns(r("Awards"))
    return df.select(
        *keep,
        r("imdbID").alias("imdb_id"), r("Title").alias("title"),
        F.replace(F.trim(r("Year")), F.lit("–"), F.lit("")).try_cast("bigint").alias("year_raw"),
        P.clean_year(r("Year")).alias("year"),
        r("Rated").alias("rated"), P.runtime_minutes(r("Runtime")).alias("runtime"),
        r("Genre").alias("genre"), r("Director").alias("director"), r("Actors").alias("actors"),
        r("Writer").alias("writer"), r("Plot").alias("plot"), r("Language").alias("language"),
        r("Country").alias("country"), r("Awards").alias("awards"),
        r("imdbRating").try_cast("double").alias("imdb_rating"),
        P.votes(r("imdbVotes")).alias("imdb_votes"),
        r("Metascore").try_cast("double").alias("metascore"),
        P.money(r("BoxOffice")).alias("box_office"),
        P.critic_score(r("Ratings")).alias("rt_score"),
        r("Type").alias("type"), P.content_type(r("Type")).alias("content_type"),
        r("Production").alias("production"),
        *[v.alias(k) for k, v in awards.items()])


# ---------------------------------------------------------------- A3 / A4 / A5 / A6

def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, columns=None,
                   null_value: str = "") -> DataFrame:
    """A3: CSV scan with an explicit null policy (only ``null_value`` is null;
    the text ``None`` stays text) and a column subset."""
    df = (spark.read.option("header", True).option("nullValue", null_value)
               .option("emptyValue", null_value).schema(schema).csv(path))
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A4 (read)."""
    return spark.read.parquet(path)


def read_seen(spark: SparkSession, path: str, people: dict[str, str]) -> DataFrame:
    """A5: JSON object {"<key>": [ids]} -> (user_id, title_id) rows.

    ``people`` maps JSON key -> user_id; ids are de-duplicated per person.
    """
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in people])
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    stacked = F.explode(F.array(*[F.struct(F.lit(u).alias("user_id"), F.col(k).alias("ids"))
                                  for k, u in people.items()]))
    return (df.select(stacked.alias("p"))
              .select("p.user_id", F.explode_outer("p.ids").alias("title_id"))
              .filter(F.col("title_id").isNotNull()).distinct())


def explode_score_map(df: DataFrame, json_col: str, keep=()) -> DataFrame:
    """JSON object id -> score (int or null) -> rows; null scores kept."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.IntegerType()))
    return df.select(*keep, F.explode(m).alias("key", "score"))


def read_score_map(spark: SparkSession, path: str) -> DataFrame:
    """A6 from a file: whole-file JSON text, parsed by Spark."""
    txt = spark.read.option("wholetext", True).text(path)
    return explode_score_map(txt, "value")


# ---------------------------------------------------------------- A7

LD_JSON = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
NEXT_DATA = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def extract_page_entities(pages: DataFrame, html_col: str = "html", keep=("page_id",)) -> DataFrame:
    """Landed HTML -> title, language, links, and (when present) cast,
    year, studio, genres from an ``ld+json`` block, severities from a
    ``__NEXT_DATA__`` block, and a ``<dt>/<dd>`` studio pair."""
    h = F.col(html_col)
    ld = F.nullif(F.regexp_extract(h, LD_JSON, 1), F.lit(""))
    nd = F.nullif(F.regexp_extract(h, NEXT_DATA, 1), F.lit(""))
    cast_json = F.get_json_object(ld, "$.actor")
    cast_schema = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
    cast = F.transform(F.from_json(cast_json, cast_schema), lambda a: a["name"])
    genres = F.from_json(F.get_json_object(ld, "$.genre"), T.ArrayType(T.StringType()))
    dd_studio = F.nullif(F.regexp_extract(
        h, r"(?s)<dt[^>]*>\s*(?:Studio|Production Co)\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1), F.lit(""))
    sev_path = "$.props.pageProps.contentData.categories"
    sev_schema = T.ArrayType(T.StructType([T.StructField("id", T.StringType()),
                                           T.StructField("severity", T.StringType())]))
    sev = F.from_json(F.get_json_object(nd, sev_path), sev_schema)
    return pages.select(
        *keep,
        F.regexp_extract(h, r"<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(h, r'<html lang="([^"]*)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(h, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("n_links"),
        cast.alias("cast"),
        F.regexp_extract(F.coalesce(F.get_json_object(ld, "$.dateCreated"), F.lit("")),
                         r"(\d{4})", 1).alias("year"),
        F.coalesce(F.get_json_object(ld, "$.productionCompany.name"), dd_studio).alias("studio"),
        genres.alias("genres"),
        sev.alias("severities"))


# ---------------------------------------------------------------- A8

def extract_ids(df: DataFrame, cols: list[str], pattern: str = r"(tt\d+)",
                must_contain: str | None = None) -> DataFrame:
    """Any cell holding an id pattern -> distinct, sorted ids."""
    cells = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("cell"))
    if must_contain:
        cells = cells.filter(F.col("cell").contains(must_contain))
    ids = cells.select(F.regexp_extract("cell", pattern, 1).alias("id")).filter(F.col("id") != "")
    return ids.distinct().orderBy("id")


# ---------------------------------------------------------------- I9 / H26 / H27

TAXONOMY_ROWS = [(c, v) for c, vs in TAG_TAXONOMY.items() for v in vs]


def taxonomy(spark: SparkSession) -> DataFrame:
    """Fixed 111-row (category, value, position) table; small by construction."""
    rows = [(c, v, i) for i, (c, v) in enumerate(TAXONOMY_ROWS)]
    return spark.createDataFrame(rows, "category string, value string, pos int")


def strip_fence(c) -> F.Column:
    """Strip a markdown code fence (and a leading ``json`` tag)."""
    t = F.trim(c)
    inner = F.when(t.startswith("```"), F.split(t, "```").getItem(1)).otherwise(t)
    return F.when(inner.startswith("json"), F.substring(inner, 5, 1 << 30)).otherwise(inner)


def ingest_tag_replies(replies: DataFrame, tax: DataFrame, id_col="title_id",
                       text_col="reply", source_col=None) -> DataFrame:
    """Model replies -> validated long tags (title_id, category, value).

    A value may be a list or a single string; values outside the taxonomy and
    unknown categories are dropped; at most two kept values per category.
    """
    body = strip_fence(F.col(text_col))
    # values may be lists or single strings: read every value as raw JSON
    # text first, then parse the lists one by one.
    raw = F.from_json(body, T.MapType(T.StringType(), T.StringType()))
    keep = [id_col] + ([source_col] if source_col else [])
    as_list = lambda v: F.when(F.trim(v).startswith("["),
                               F.from_json(v, T.ArrayType(T.StringType()))).otherwise(F.array(v))
    exploded = (replies.select(*keep, F.explode(raw).alias("category", "raw"))
                .select(*keep, "category", F.posexplode(as_list(F.col("raw"))).alias("i", "value")))
    valid = exploded.join(F.broadcast(tax.select("category", "value")), ["category", "value"], "left_semi")
    w_keys = keep + ["category"]
    ranked = valid.groupBy(*w_keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_v"))   # <= values per reply
    return (ranked.select(*keep, "category", F.explode(F.slice("_v", 1, 2)).alias("x"))
                  .select(*keep, "category", F.col("x.value").alias("value")))


def validate_guide(df: DataFrame, cols=GUIDE_COLUMNS) -> DataFrame:
    """Title-case each severity; keep rows whose five severities are all valid."""
    cleaned = df.withColumns({c: P.clean_severity(c) for c in cols})
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return cleaned.filter(ok)


def prefer_sources(df: DataFrame, key: str, source_col: str, ranking: list[str],
                   ok_col: str | None = None) -> DataFrame:
    """One result per key by source preference (e.g. page > model A > model B).
    A source that is not listed comes after all that are."""
    at = F.array_position(F.array(*[F.lit(s) for s in ranking]), F.col(source_col))
    rank = F.when(at > 0, at).otherwise(len(ranking) + 1)
    d = df
    if ok_col:
        d = d.filter(F.col(ok_col).isNotNull())
    return dedupe(d.withColumn("_rank", rank), key, "_rank").drop("_rank")
