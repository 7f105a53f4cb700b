"""Hot groups: one person / stratum holding most rows must give the same
exact answers as the straightforward (single-task) formulation."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelrank.functions.nulls import dedupe
from reelrank.operators import similarity as S
from reelrank.operators.split import stratified_split


def test_split_hot_stratum_equals_full_sort(spark):
    # 40,000 rows in one (person, bin) stratum + two small people
    hot = spark.range(40000).select(F.lit("hot").alias("user_id"), F.col("id").alias("title_id"),
                                    F.lit(6.0).alias("rating"))
    small = spark.range(300).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("user_id"),
                                    F.col("id").alias("title_id"), ((F.col("id") % 10) + 1).cast("double").alias("rating"))
    df = hot.unionByName(small)
    got = stratified_split(df)
    h = F.md5(F.concat(F.col("title_id").cast("string"), F.lit(":42")))
    from reelrank.operators.split import rating_bin
    ref = (df.withColumn("bin", rating_bin("rating")).withColumn("_h", h)
             .withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "bin").orderBy("_h", "title_id")))
             .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "bin")))
             .withColumn("is_test", F.coalesce((F.col("rn") <= F.round(F.col("n") * 0.2)) & F.col("bin").isNotNull(),
                                               F.lit(False))))
    a = got.select("user_id", "title_id", "is_test")
    b = ref.select("user_id", "title_id", "is_test")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert got.filter((F.col("user_id") == "hot") & F.col("is_test")).count() == 8000


def test_dedupe_hot_key(spark):
    df = spark.range(50000).select((F.col("id") % 3 == 0).cast("int").alias("k"),
                                   (F.col("id") * 7919 % 50000).alias("ord"), F.col("id").alias("v"))
    got = {r.k: r.v for r in dedupe(df, "k", "ord").collect()}
    exp = {r.k: r.v for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("ord")))
           .filter("rn = 1").collect()}
    assert got == exp


def test_nearest_rated_hot_person_many_blocks(spark):
    rng = np.random.default_rng(7)
    nq, nh, dim = 300, 1500, 8
    qv, hv = rng.normal(size=(nq, dim)), rng.normal(size=(nh, dim))
    qs, hs = rng.integers(1, 10, nq).astype(float), rng.integers(1, 10, nh).astype(float)
    sch = "user_id string, id long, vec array<float>, tags array<string>, score double"
    q = spark.createDataFrame([("hot", int(i), [float(x) for x in qv[i]], [], float(qs[i])) for i in range(nq)], sch)
    h = spark.createDataFrame([("hot", int(10000 + j), [float(x) for x in hv[j]], [], float(hs[j])) for j in range(nh)], sch)
    got = {r.query_id: (r.match_id, r.similarity) for r in S.nearest_rated(q, h, block=128).collect()}
    # brute force in numpy (float32 inputs, as stored)
    qf, hf = qv.astype(np.float32).astype(float), hv.astype(np.float32).astype(float)
    cos = (qf @ hf.T) / np.outer(np.linalg.norm(qf, axis=1), np.linalg.norm(hf, axis=1))
    comb = 0.85 * np.clip(cos, 0, 1) + 0.15 * np.clip(1 - np.abs(hs[None, :] - qs[:, None]) / 10, 0, 1)
    best = comb.argmax(axis=1)
    assert len(got) == nq
    for i in range(nq):
        m, s = got[i]
        assert m == 10000 + int(best[i])
        assert s == pytest.approx(comb[i, best[i]], abs=1e-9)


def test_exact_median_hot_group_and_tiny_groups(spark):
    from reelrank.operators.aggregates import exact_median
    rng = np.random.default_rng(11)
    big = rng.lognormal(10, 2, 60000)
    rows = [("hot", float(x)) for x in big] + [("one", 5.0), ("two", 1.0), ("two", 4.0),
                                              ("even", 1.0), ("even", 2.0), ("even", 3.0), ("even", 10.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.median for r in exact_median(df, "x", ["g"]).collect()}
    assert got["hot"] == pytest.approx(float(np.median(big)), rel=1e-12)
    assert got["one"] == 5.0 and got["two"] == 2.5 and got["even"] == 2.5
