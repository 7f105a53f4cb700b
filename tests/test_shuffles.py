"""What grows with the tables is shuffled once and never passes the driver."""

from pyspark.sql import functions as F

from reelrank.llm import simhash
from reelrank.operators.split import stratified_split
from reelrank.plans import q_cards, q_model
from reelrank.plans import views as V
from reelrank.session import checkpoint

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_is_never_broadcast(spark):
    """The files of customer, orders and part are small, what they hold is not."""
    t = V.Tables(spark, SF)
    for df in (V.rated(t), V.title_info(t), V.history_full(t)):
        assert "BroadcastHashJoin" not in plan(df)


def test_details_never_broadcast_titles(spark):
    """Metadata, posters and guides hold a row a title, whatever their files' sizes."""
    t = V.Tables(spark, SF)
    guides = t.documents.select(F.col("doc_id").alias("title_id"), *[F.col("lang").alias(c) for c in q_cards.G5])
    out = q_cards.full_details(checkpoint(q_cards.catalog(spark, SF)), q_cards.flat(spark, SF), q_cards._posters(t), guides)
    assert "BroadcastHashJoin" not in plan(out) and out.count()


def test_history_columns(spark):
    t = V.Tables(spark, SF)
    assert V.history(t, "rating").columns == ["user_id", "title_id", "rating"]
    whole = V.history(t).select("user_id", "title_id", "rating")
    assert not whole.exceptAll(V.history(t, "rating")).count() and whole.count() == V.history(t, "rating").count()


def test_split_reads_its_rows_in_one_branch(spark):
    rows = spark.createDataFrame([("a", i, float(i % 10 + 1)) for i in range(500)], "user_id string, title_id long, rating double")
    out = stratified_split(rows)
    assert "Union" not in plan(out)
    got = out.groupBy("bin").agg(F.count_if("is_test").alias("k"), F.count("*").alias("n")).collect()
    assert all(r.k == round(r.n * 0.2) for r in got)


def test_near_duplicates_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"some words of a text {i % 7}") for i in range(40)], "doc_id long, text string")
    assert "BroadcastHashJoin" not in plan(simhash.near_duplicates(docs))


def test_submissions_read_the_history_once(spark, monkeypatch):
    """Side tables and metrics of both versions come from one stored history."""
    frames = []
    real = q_model.C.submit

    def submit(spark, base, version, metrics, path, side):
        frames.extend([metrics, *side.values()])
        return real(spark, base, version, metrics, path, side)
    monkeypatch.setattr(q_model.C, "submit", submit)
    q_model._two_submissions(spark, SF)
    assert len(frames) == 6 and not any("lineitem" in plan(f) for f in frames)
