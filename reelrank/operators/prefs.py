"""Preference statistics for one person and one title (D7), for every
(person, title) pair of a candidate table at once.

A title's main genre and first director match every rated row whose list
contains that text, case ignored (``Music`` matches ``Musical``).  The match is
made between the distinct texts of both sides, through an index of short pieces
(``joins.containing``); ratings are summed by (person, whole text) before.
Sides that grow with titles are never broadcast: titles of a small, well packed
file unfold to many times its size in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import first_item
from ..session import checkpoint
from .joins import containing, join_per_person


def preference_stats(history: DataFrame, candidates: DataFrame, history_tags: DataFrame,
                     candidate_tags: DataFrame) -> DataFrame:
    """D7 per (user_id, title_id) of ``candidates``.

    history: user_id, title_id, rating, runtime, genre, director
    candidates: user_id, title_id, genre, director
    history_tags / candidate_tags: title_id, tag, pos (candidate tag order)
    """
    base = history.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_rated"),
        F.bround(F.avg("rating"), 1).alias("avg_overall"),
        F.count_if((F.col("rating") >= 7) & F.col("runtime").isNotNull()).alias("_nl"),
        F.avg(F.when(F.col("rating") >= 7, F.col("runtime").cast("double"))).alias("_rl"))
    base = base.select("user_id", "total_rated", "avg_overall",
                       F.when(F.col("_nl") > 5, F.bround("_rl", 0).cast("int")).alias("avg_runtime_liked"))

    def text_stats(col, key, name, min_n):
        whole = (history.select("user_id", "rating", F.lower(col).alias("text")).where(F.col("text").isNotNull())
                 .groupBy("user_id", "text").agg(F.count(F.lit(1)).alias("_n"), F.sum("rating").alias("_s")))
        pairs = containing(c.select(key).distinct(), whole.select("text").distinct())
        st = (whole.join(pairs.hint("merge"), "text").groupBy("user_id", F.col("needle").alias(key))
              .agg(F.sum("_n").alias(f"{name}_count"), F.sum("_s").alias("_s")))
        return st.filter(F.col(f"{name}_count") >= min_n).select(
            "user_id", key, f"{name}_count", F.bround(F.col("_s") / F.col(f"{name}_count"), 1).alias(f"{name}_avg"))

    c = candidates.select("user_id", "title_id",
                          first_item("genre").alias("genre_name"),
                          F.lower(first_item("genre")).alias("_gk"),
                          F.lower(first_item("director")).alias("_dk"))
    # a row a person and text, or tag: stored, so that the driver holds their plans one at a time
    g, d = checkpoint(text_stats("genre", "_gk", "genre", 3)), checkpoint(text_stats("director", "_dk", "director", 2))
    out = (join_per_person(c, base, ["title_id"])
           .join(g.hint("merge"), ["user_id", "_gk"], "left")
           .join(d.hint("merge"), ["user_id", "_dk"], "left"))

    # tag with >= 5 rated titles whose rounded mean deviates most from the average
    ht = history.select("user_id", "title_id", "rating").join(history_tags.select("title_id", "tag").hint("merge"), "title_id")
    ts = (ht.groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("_n"), F.avg("rating").alias("_a"))
            .filter(F.col("_n") >= 5).select("user_id", "tag", "_n", F.bround("_a", 1).alias("_ta")))
    ct = candidates.select("user_id", "title_id").join(candidate_tags.hint("merge"), "title_id")
    # the average goes with the tags' few rows, not with the candidates
    ts = checkpoint(join_per_person(ts, base.select("user_id", "avg_overall"), ["tag"], "inner")
                    .withColumn("_delta", F.abs(F.col("_ta") - F.col("avg_overall"))).filter(F.col("_delta") > 0))
    cand = ct.join(ts, ["user_id", "tag"])
    top = cand.groupBy("user_id", "title_id").agg(F.max_by(
        F.struct(F.col("tag").alias("top_tag"), F.col("_ta").alias("top_tag_avg"),
                 F.col("_n").alias("top_tag_count")),
        F.struct(F.col("_delta"), -F.col("pos"))).alias("t"))
    out = out.join(top.select("user_id", "title_id", "t.*").hint("merge"), ["user_id", "title_id"], "left")
    return out.select("user_id", "title_id", "total_rated", "avg_overall", "avg_runtime_liked",
                      F.when(F.col("genre_count").isNotNull(), F.col("genre_name")).alias("genre_name"),
                      "genre_count", "genre_avg", "director_count", "director_avg",
                      "top_tag", "top_tag_avg", "top_tag_count")
