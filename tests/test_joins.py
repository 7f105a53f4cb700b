"""Substring join against a plain search; salted joins keep every row."""

import random

from pyspark.sql import functions as F

from reelrank.operators import joins as J
from reelrank.operators import prefs


def test_containing(spark):
    rng = random.Random(4)
    words = ["music", "musical", "drama", "é", "日本", "a", "ma", "x_%y", "war", "warcraft"]
    texts = sorted({", ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(60)} | {"", "m"})
    needles = sorted({*words, "rama", "sic", "zzz", "m", "l, d"})
    got = J.containing(spark.createDataFrame([(n,) for n in needles] + [("",), (None,)], "n string"),
                       spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")).collect()
    assert sorted(map(tuple, got)) == sorted((n, t) for n in needles for t in texts if n in t)


def test_join_per_person(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "a").when(F.col("id") < 490, "b").otherwise("c").alias("user_id"), "id")
    people = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, v int")
    out = J.join_per_person(rows, people, ["id"])
    assert out.columns == ["user_id", "id", "v"] and out.count() == 500
    assert {(r.user_id, r.v) for r in out.collect()} == {("a", 1), ("b", 2), ("c", None)}
    assert J.join_per_person(rows, people, ["id"], "inner").count() == 490
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_music_matches_musical(spark):
    history = spark.createDataFrame([("u", i, 8.0, 100, g, "Jo Li, X") for i, g in enumerate(["Musical", "Music, War", "Drama", "musical, a"])],
                                    "user_id string, title_id long, rating double, runtime int, genre string, director string")
    cands = spark.createDataFrame([("u", 9, "Music", "jo l"), ("u", 8, "Drama", None)], "user_id string, title_id long, genre string, director string")
    tags = spark.createDataFrame([], "title_id long, tag string, pos int")
    got = {r.title_id: r for r in prefs.preference_stats(history, cands, tags.drop("pos"), tags).collect()}
    assert (got[9].genre_name, got[9].genre_count, got[9].director_count) == ("Music", 3, 4)
    assert (got[8].genre_count, got[8].director_count) == (None, None)


def test_rows_that_may_hold_a_key(spark):
    """No row of a key is lost, few others stay, and nothing is shuffled by the rows' key."""
    from reelrank.operators.joins import may_hold
    rows = spark.range(100_000).selectExpr("id AS k", "id % 3 AS v").unionByName(spark.createDataFrame([(None, 1), (-5, 2)], "k long, v long"))
    keys = spark.createDataFrame([(i * 97,) for i in range(500)] + [(-5,), (97,)], "k long")
    found = may_hold(rows, "k", keys)
    got = [r.k for r in found.collect()]
    assert {r.k for r in keys.collect()} <= set(got) and len(got) < 700
    assert may_hold(rows, "k", keys.limit(0)).count() == 0
    assert "k#" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(k" in x)
