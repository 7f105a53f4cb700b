"""Pages from the rank index against the sorted list, and what a page reads."""

from pyspark.sql import functions as F

from reelrank.operators.rank_index import read_page, write_rank_index


def test_pages(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 50).alias("v"), F.lit("x").alias("said"))
    order = [F.col("v").desc(), F.col("id").asc()]
    want = [r.id for r in df.orderBy(*order).collect()]
    path = str(tmp_path / "i")
    write_rank_index(df, order, path, rows_a_range=60)
    for offset, n in ((0, 8), (8, 16), (55, 130), (980, 50), (1000, 5)):
        page = read_page(spark, path, order, n, offset)
        assert [(r.id, r.pos) for r in page.orderBy("pos").collect()] == [
            (i, offset + k + 1) for k, i in enumerate(want[offset:offset + n])]
    deep = read_page(spark, path, order, 16, 500)
    assert len({r.f for r in deep.select(F.input_file_name().alias("f")).collect()}) <= 2


def test_empty(spark, tmp_path):
    df = spark.range(5).where("id < 0")
    write_rank_index(df, [F.col("id")], str(tmp_path / "e"))
    assert read_page(spark, str(tmp_path / "e"), [F.col("id")], 8).count() == 0
