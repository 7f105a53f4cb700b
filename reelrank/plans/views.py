"""Stand-in views over the driver tables.

The application's own data files are not available, so its tables are
re-aimed at the driver tables.  Each view below has a twin SQL definition in
:mod:`reelrank.plans.oracle_views`; the two must stay identical in meaning.

People are rows: ``user_id`` is the customer market segment (five people).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import may_hold
from ..session import checkpoint

PERSON_A = "AUTOMOBILE"
PERSON_B = "BUILDING"

RATED_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


class Tables:
    """Lazy parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def people(t: Tables) -> DataFrame:
    """Everyone who rates, one row each."""
    return t.customer.select(F.col("c_mktsegment").alias("user_id")).dropna().distinct()


def rated(t: Tables, titles: DataFrame | None = None) -> DataFrame:
    """One row per rating event: lineitem joined to its order and customer.
    ``titles`` (title_id): those of these titles alone.

    Line items of other titles go before any shuffle (``may_hold``).  Orders
    meet their customers first, so that lineitem is shuffled once more.  The
    small files of customer and part unfold to many times their size: joins
    with them are never broadcast (``merge``)."""
    li = t.lineitem
    if titles is not None:
        li = may_hold(li, "l_partkey", titles.select("title_id"))
        li = li.join(titles.select(F.col("title_id").alias("_wanted")).distinct(),
                     li.l_partkey == F.col("_wanted"), "left_semi")
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("user_id"))
    o = t.orders.select("o_orderkey", "o_custkey")
    o = o.join(c.hint("merge"), F.col("o_custkey") == c.c_custkey).select("o_orderkey", "user_id")
    return (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
              .select("user_id",
                      F.col("l_partkey").alias("title_id"),
                      F.col("l_suppkey").alias("director_id"),
                      ((F.col("l_quantity").cast("bigint") % 10) + 1).cast("double").alias("rating"),
                      F.year("l_shipdate").alias("year"),
                      "l_returnflag", *RATED_ORDER))


def history(t: Tables, *columns: str, titles: DataFrame | None = None) -> DataFrame:
    """``rated`` with one row per (user, title): the first by input order.

    The title is the part and the director the supplier, so the rows travel
    without copies of them, and the order holds the columns that it sorts by.
    ``columns`` of rating, year and l_returnflag: these alone beside the keys.
    ``titles``: of these titles alone."""
    keys, order = ["user_id", "title_id"], [c for c in RATED_ORDER if c != "l_partkey"]
    r = rated(t, titles)
    first = r.groupBy(*keys).agg(F.min(F.struct(*order, *(columns or ("rating", "year", "l_returnflag")))).alias("_r"))
    if columns:
        return first.select(*keys, *[F.col("_r." + c).alias(c) for c in columns])
    return first.select(*keys, "_r.*").withColumns(
        {"director_id": F.col("l_suppkey"), "l_partkey": F.col("title_id")}).select(*r.columns)


def seen(t: Tables) -> DataFrame:
    """Distinct (user, title) pairs the person has seen: returned line items."""
    return (rated(t).filter(F.col("l_returnflag") == "R")
                    .select("user_id", "title_id").distinct())


def titles(t: Tables) -> DataFrame:
    p = t.part
    return p.select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"),
                    F.col("p_brand").alias("studio"), F.col("p_type").alias("genre"),
                    F.col("p_size").alias("runtime"), F.col("p_retailprice").alias("box_office"))


def listing(t: Tables) -> DataFrame:
    """Every (title, service) offer: lineitem -> supplier -> nation -> region."""
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    n = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))   # 25 rows, fixed
    r = F.broadcast(t.region.select("r_regionkey", "r_name"))        # 5 rows, fixed
    return (li.join(s, li.l_suppkey == s.s_suppkey)
              .join(n, F.col("s_nationkey") == n.n_nationkey)
              .join(r, F.col("n_regionkey") == r.r_regionkey)
              .select(F.col("l_partkey").alias("title_id"), F.col("r_name").alias("service"),
                      F.col("r_regionkey").alias("service_rank"), "l_orderkey", "l_linenumber"))


def catalog_base(t: Tables) -> DataFrame:
    """Title attributes of the streaming catalog (no scores yet)."""
    p = t.part
    return p.select(
        F.col("p_partkey").alias("title_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_type").isin("PROMO", "SMALL"), "tv").otherwise("movie").alias("type"),
        ((F.col("p_retailprice") - 900.0) / 10.0).alias("imdb_score"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("int"))
         .otherwise(F.col("p_size") * 2 + 1940).alias("year"),
        F.col("p_size").alias("runtime"),
        F.col("p_type").alias("genre"),
        F.col("p_brand").alias("studio"))


def title_info(t: Tables) -> DataFrame:
    """Title attributes used by the encoders.

    director = supplier of the title's first line item (one aggregate over
    lineitem, combined map-side); cast list = the words of the name.
    """
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    first = (li.groupBy("l_partkey")
               .agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))["l_suppkey"].alias("sup")))
    p = t.part
    return (p.join(first.hint("merge"), p.p_partkey == first.l_partkey, "left")
             .select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"),
                     F.col("sup").cast("string").alias("director"),
                     F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("actors"),
                     F.col("p_brand").alias("studio"), F.col("p_type").alias("genre"),
                     F.col("p_size").alias("runtime"),
                     F.col("p_retailprice").alias("box_office")))


def history_full(t: Tables, *columns: str, info: DataFrame | None = None) -> DataFrame:
    """``history`` (of ``columns``) with the title attributes attached
    (``info``: ``title_info``, where it is stored)."""
    h = history(t, *columns) if columns else history(t).select("user_id", "title_id", "rating", "year", *RATED_ORDER)
    return h.join((title_info(t) if info is None else info).hint("merge"), "title_id")


def stored_history(t: Tables) -> tuple[DataFrame, DataFrame]:
    """``title_info`` and everyone's ``history_full`` (of rating), written once
    for a query that reads them often: each reader would make both anew, and
    the driver would hold the plans of all."""
    info = checkpoint(title_info(t))
    return info, checkpoint(history_full(t, "rating", info=info).select(
        "user_id", "title_id", "rating", "director", "actors", "studio", "genre", "runtime"))


def title_vectors(t: Tables) -> DataFrame:
    """Titles that have a plot vector: embeddings row ``vec_id`` is title ``vec_id``.

    tags = the words of the title name with five letters or more (may be empty);
    score = the catalog score of the title.
    """
    e = t.embeddings.select(F.col("vec_id").alias("title_id"), F.col("embedding").alias("vec"))
    c = catalog_base(t).select("title_id", "title", F.col("imdb_score").alias("score"))
    tags = F.array_distinct(F.filter(F.split(F.col("title"), " "), lambda w: F.length(w) >= 5))
    return e.join(c, "title_id").select("title_id", "vec", tags.alias("tags"), "score")
