"""Registry: the worse version does not move the pointer, side tables read back."""

from reelrank.plans import champions as C

METRICS = "user_id string, n long, mae double, rmse double, r2 double"


def test_pointer(spark, tmp_path):
    base = str(tmp_path)

    def submit(version, *rows):
        C.submit(spark, base, version, spark.createDataFrame([(u, 5, mae, mae, r2) for u, mae, r2 in rows], METRICS), f"/m/{version}",
                 {"names": spark.createDataFrame([(version,)], "v string")})
        return {r.user_id: r.model_version for r in C.current_models(spark, base).collect()}
    assert C.current_models(spark, base).count() == 0
    assert submit("v1", ("a", 0.7, 0.3), ("b", 0.6, 0.4)) == {"a": "v1", "b": "v1"}
    assert submit("v2", ("a", 0.699, 0.3), ("b", 0.8, 0.1)) == {"a": "v1", "b": "v1"}          # no better
    assert submit("v3", ("a", 0.69, 0.3), ("b", 0.9, 0.2), ("c", 2.0, 0.0)) == {"a": "v3", "b": "v1", "c": "v3"}
    assert C.saved_metrics(spark, base).count() == 7
    assert C.saved_table(spark, base, "v2", "names").first().v == "v2"
    assert {r.model_path for r in C.current_models(spark, base).collect()} == {"/m/v1", "/m/v3"}
