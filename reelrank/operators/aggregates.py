"""Aggregations: medians, scaling, tag statistics, preference stats, metrics,
coverage, vocabularies and freshness (D2, D3, D5-D13).

Statistics that the application computes "per person" are grouped by
``user_id`` and joined back on it, so the plan is the same for two people or
two million.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import clip_rating
from .joins import join_per_person


def exact_median(df: DataFrame, col: str, by: list[str], accuracy: int = 10_000) -> DataFrame:
    """Exact median (linear interpolation between the two middle values, as
    ``median`` / ``percentile(0.5)``) per group, without holding a group's
    distinct values in one aggregation buffer.

    1. ``percentile_approx`` brackets the middle ranks of each group (rank
       error <= n / accuracy, so the bracket holds ~4n / accuracy rows);
    2. rows below the bracket are only counted; the distinct values inside it
       are ranked with their counts, which gives the exact middle values;
    3. a group whose bracket misses the middle ranks (possible only for tiny
       or odd groups) is answered by the exact ``median`` on that group alone.
    """
    eps = 2.0 / accuracy
    v = df.select(*by, F.col(col).cast("string").try_cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    st = v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(F.lit(max(0.0, 0.5 - eps)), F.lit(min(1.0, 0.5 + eps))),
                            accuracy).alias("_q"))
    st = st.select(*by, "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"),
                   F.floor((F.col("_n") - 1) / 2).alias("_rlo"), F.ceil((F.col("_n") - 1) / 2).alias("_rhi"))
    j = v.join(st, by)
    counts = j.groupBy(*by).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"),
                                F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_in"))
    ok = (counts.join(st, by)
                .filter((F.col("_below") <= F.col("_rlo")) & (F.col("_below") + F.col("_in") > F.col("_rhi"))))
    # ties collapse into one row with its count, so a hot value is no hot key
    tied = (j.filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
             .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"),
                                     F.first("_rlo").alias("_rlo"), F.first("_rhi").alias("_rhi"))
             .join(ok.select(*by, "_below"), by)
             .withColumn("_end", F.col("_below") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))))

    def holds(rank):
        return (F.col("_end") - F.col("_c") <= F.col(rank)) & (F.col(rank) < F.col("_end"))

    mids = tied.groupBy(*by).agg(
        F.max(F.when(holds("_rlo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(holds("_rhi"), F.col("_v"))).alias("_vhi"),
        F.first("_n").alias("_n"), F.first("_rlo").alias("_rlo"))
    frac = (F.col("_n") - 1) / 2.0 - F.col("_rlo")
    exact = mids.select(*by, (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).alias("median"))
    rest = v.join(ok.select(*by), by, "left_anti").groupBy(*by).agg(F.median("_v").alias("median"))
    return exact.unionByName(rest)


def median_impute(df: DataFrame, cols: list[str], by: str = "user_id") -> DataFrame:
    """Coerce columns to double and fill nulls with the group's exact median."""
    num = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})
    out = num.join(group_medians(num, cols, by), by, "left")
    return out.select(*[F.coalesce(F.col(c), F.col("_med_" + c)).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def group_medians(df: DataFrame, cols: list[str], by: str = "user_id") -> DataFrame:
    """One row per group: the exact medians ``_med_<col>`` of all columns, from
    one unpivoted pass (null where a column has no value)."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))
                                             for c in cols])).alias("_s")).select(by, "_s.c", "_s.v")
    return (exact_median(long, "v", [by, "c"]).groupBy(by)
            .agg(*[F.max(F.when(F.col("c") == c, F.col("median"))).alias("_med_" + c) for c in cols]))


def scaler_stats(df: DataFrame, cols: list[str], by: str = "user_id") -> DataFrame:
    """D3 (fit): mean and population stddev per group and column."""
    return df.groupBy(by).agg(*[x for c in cols for x in (
        F.avg(c).alias("_mu_" + c), F.stddev_pop(c).alias("_sd_" + c))])


def standardise(df: DataFrame, stats: DataFrame, cols: list[str], by: str = "user_id") -> DataFrame:
    """D3 (apply): (x - mean) / stddev_pop; zero spread divides by 1; null -> mean."""
    out = join_per_person(df, stats, [c for c in df.columns if c != by], key=by)
    def z(c):
        sd = F.col("_sd_" + c)
        sd = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        x = F.coalesce(F.col(c).cast("double"), F.col("_mu_" + c))
        return ((x - F.col("_mu_" + c)) / sd).alias(c)
    return out.select(*[z(c) if c in cols else F.col(c) for c in df.columns])


def tag_frequency(tags: DataFrame) -> DataFrame:
    """Share of titles carrying each tag (tags: title_id, tag)."""
    pairs = tags.select("title_id", "tag").distinct()
    total = pairs.agg(F.countDistinct("title_id").alias("_total"))
    counts = pairs.groupBy("tag").agg(F.count(F.lit(1)).alias("n_titles"))
    # one-row total, joined on a constant key (no cartesian product)
    return (counts.withColumn("_k", F.lit(1))
                  .join(total.withColumn("_k", F.lit(1)), "_k")
                  .select("tag", "n_titles", (F.col("n_titles") / F.col("_total")).alias("freq")))


def tag_cooccurrence(tags: DataFrame, low: float = 0.10, high: float = 0.80,
                     top_k: int = 10, min_support: int = 25) -> DataFrame:
    """Interaction features among frequent tags.

    Candidates are the ``top_k`` most frequent tags with frequency in
    [low, high]; a candidate is kept when some pair of candidates co-occurs
    on >= ``min_support`` titles; the result is every pair of kept tags with
    its feature name ``ix__a__b``.  The self-join is on title among at most
    ``top_k`` candidate tags per title, so its output per title is bounded by
    top_k*(top_k-1)/2 whatever the data size.
    """
    freq = tag_frequency(tags)
    cands = (freq.filter(F.col("freq").between(low, high))
                 .orderBy(F.col("n_titles").desc(), F.col("tag").asc()).limit(top_k)
                 .select("tag"))
    ct = tags.select("title_id", "tag").distinct().join(F.broadcast(cands), "tag")  # <= top_k rows
    a, b = ct.alias("a"), ct.alias("b")
    pairs = (a.join(b, (F.col("a.title_id") == F.col("b.title_id")) & (F.col("a.tag") < F.col("b.tag")))
              .groupBy(F.col("a.tag").alias("tag_a"), F.col("b.tag").alias("tag_b"))
              .agg(F.count(F.lit(1)).alias("support")))
    strong = pairs.filter(F.col("support") >= min_support)
    kept = (strong.select(F.col("tag_a").alias("tag"))
                  .union(strong.select(F.col("tag_b").alias("tag"))).distinct())
    ka, kb = kept.alias("ka"), kept.alias("kb")
    # all pairs of kept tags (<= top_k^2 / 2 rows), with their support
    allp = ka.join(F.broadcast(kb), F.col("ka.tag") < F.col("kb.tag")) \
             .select(F.col("ka.tag").alias("tag_a"), F.col("kb.tag").alias("tag_b"))
    return (allp.join(pairs, ["tag_a", "tag_b"], "left")
                .select("tag_a", "tag_b",
                        F.coalesce(F.col("support"), F.lit(0)).alias("support"),
                        F.concat(F.lit("ix__"), F.col("tag_a"), F.lit("__"), F.col("tag_b"))
                         .alias("feature")))


def regression_metrics(df: DataFrame, label: str = "rating", pred: str = "prediction",
                       by: str = "user_id") -> DataFrame:
    """Clip predictions to 1-10, then MAE, RMSE and R^2 per group, in one
    pass: the variance aggregate merges centred moments map-side."""
    e = F.col(label) - clip_rating(pred)
    stats = df.groupBy(by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"), (F.var_pop(label) * F.count(label)).alias("_sst"), F.count(F.lit(1)).alias("n"))
    return stats.select(by, "n", "mae", "rmse",
                        (1 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))).alias("r2"))


def feature_importance(contrib: DataFrame, n: int = 15, by: str = "user_id") -> DataFrame:
    """D10 + F3: mean absolute contribution per feature, top ``n`` per group."""
    imp = contrib.groupBy(by, "feature").agg(F.avg(F.abs("contrib")).alias("importance"))
    # importance to 9 digits, then name: a stable rule for exact ties
    w = Window.partitionBy(by).orderBy(F.round("importance", 9).desc(), F.col("feature").asc())
    return imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def coverage_report(df: DataFrame, result_col: str, by: str | None = None) -> DataFrame:
    """Rows, successes, failures and success percent (optionally per group)."""
    ok = F.col(result_col).isNotNull() & (F.trim(F.col(result_col).cast("string")) != "")
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("ok"),
            F.count_if(~ok).alias("failed")]
    g = df.groupBy(by) if by else df.groupBy()
    out = g.agg(*aggs)
    return out.withColumn("pct_ok", F.bround(F.col("ok") * 100.0 / F.col("rows"), 1))


def genre_vocabulary(df: DataFrame, genre_col: str = "genre") -> DataFrame:
    """Distinct sorted genre items; ``Unknown`` and blanks give no genre."""
    items = df.select(F.explode(F.split(F.col(genre_col), ",")).alias("g")) \
              .select(F.trim("g").alias("genre"))
    return (items.filter(~F.col("genre").isin("", "N/A", "Unknown")).distinct()
                 .orderBy("genre"))


def catalog_freshness(df: DataFrame, ts_col: str, now: DataFrame, max_age_days: int = 7) -> DataFrame:
    """Age in days of the newest row against ``now`` (a one-row frame
    with column ``now``); missing or older than max age -> refresh."""
    newest = df.agg(F.max(ts_col).alias("newest")).withColumn("_k", F.lit(1))
    j = newest.join(now.withColumn("_k", F.lit(1)), "_k")   # one row with one row
    age = F.datediff(F.to_date("now"), F.to_date("newest"))
    return j.select("newest", age.alias("age_days"),
                    (F.col("newest").isNull() | (age > max_age_days)).alias("needs_refresh"))
