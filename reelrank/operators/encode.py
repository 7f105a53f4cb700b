"""Entity encodings: leave-one-out (E1), entity statistics (D4), lookups.

Entities are a person's primary director, top-billed actor and studio.  All
statistics are ``groupBy`` aggregates joined back on their key, never a
window over a whole entity: a studio holding a third of the rows is summed
map-side and joined back as one small row, with AQE splitting the skewed
side of the join if needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import primary_actor, primary_director, studio_key
from .joins import join_per_person

KINDS = ("director", "actor1", "studio")


def with_entities(df: DataFrame, cast_col: str | None = None) -> DataFrame:
    """Add ``director``/``actor1``/``studio`` entity keys (primary items)."""
    cast_c = F.col(cast_col) if cast_col else F.lit(None).cast("string")
    return df.withColumns({
        "_director": primary_director("director"),
        "_actor1": primary_actor(cast_c, F.col("actors")),
        "_studio": studio_key("studio"),
    })


def _long(df: DataFrame) -> DataFrame:
    """Unpivot the three entity keys into (kind, entity) rows."""
    return df.select("user_id", "title_id", "rating", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col("_" + k).alias("entity")) for k in KINDS
    ])).alias("e")).select("user_id", "title_id", "rating", "e.kind", "e.entity")


def overall_average(history: DataFrame) -> DataFrame:
    """Mean rating per person."""
    return history.groupBy("user_id").agg(F.avg("rating").alias("overall_avg"))


def entity_stats(history: DataFrame) -> DataFrame:
    """Count and mean rating per (person, kind, entity)."""
    return (_long(with_entities(history)).filter(F.col("entity").isNotNull())
            .groupBy("user_id", "kind", "entity")
            .agg(F.count("rating").alias("n"), F.avg("rating").alias("avg")))


def leave_one_out(history: DataFrame) -> DataFrame:
    """Per rated row, count and mean of the *other* rows of the same entity.

    Singleton entities get count 0 and the person's overall average.
    ``history`` holds one row per (person, title); deduplicate it first.
    Output: user_id, title_id, rating, and {kind}_film_count / {kind}_avg_rating.
    """
    rows = with_entities(history).select("user_id", "title_id", "rating", *["_" + k for k in KINDS])
    sums = (_long(rows).where(F.col("entity").isNotNull()).groupBy("user_id", "kind", "entity")
            .agg(F.sum("rating").alias("s"), F.count("rating").alias("n")))
    for k in KINDS:
        mine = sums.where(F.col("kind") == k).select("user_id", F.col("entity").alias("_" + k), F.col("s").alias(f"_s_{k}"),
                                                     F.col("n").alias(f"_n_{k}"))
        rows = rows.join(mine, ["user_id", "_" + k], "left").drop("_" + k)
    rows = join_per_person(rows, overall_average(history), ["title_id"], "inner")
    cnt = {k: F.coalesce(F.col(f"_n_{k}"), F.lit(1)) - 1 for k in KINDS}
    avg = {k: F.coalesce((F.col(f"_s_{k}") - F.col("rating")) / F.nullif(cnt[k], F.lit(0)).cast("double"), F.col("overall_avg"))
           for k in KINDS}
    return rows.groupBy("user_id", "title_id", "rating").agg(*[x for k in KINDS for x in (
        F.max(cnt[k]).alias(f"{k}_film_count"), F.max(avg[k]).alias(f"{k}_avg_rating"))])


def lookup_entity_stats(candidates: DataFrame, stats: DataFrame, overall: DataFrame) -> DataFrame:
    """For unseen (user, title) rows, count/avg of their entities; default 0 and overall avg.

    ``candidates`` carries user_id, title_id and the title attribute columns.
    """
    long = with_entities(candidates).select("user_id", "title_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col("_" + k).alias("entity")) for k in KINDS
    ])).alias("e")).select("user_id", "title_id", "e.kind", "e.entity")
    j = join_per_person(long.join(stats, ["user_id", "kind", "entity"], "left"), overall, ["title_id"])
    per = j.select("user_id", "title_id", "kind",
                   F.coalesce(F.col("n"), F.lit(0)).alias("cnt"),
                   F.coalesce(F.col("avg"), F.col("overall_avg")).alias("avg"))
    return (per.groupBy("user_id", "title_id")
               .agg(*[x for k in KINDS for x in (
                   F.max(F.when(F.col("kind") == k, F.col("cnt"))).alias(f"{k}_film_count"),
                   F.max(F.when(F.col("kind") == k, F.col("avg"))).alias(f"{k}_avg_rating"))]))
