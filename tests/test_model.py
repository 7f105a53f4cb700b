"""Model properties: tree-path attribution is additive (I5) and the model
beats "predict the mean" on a table with a planted signal (I3).

Small round counts keep the tests fast; the properties do not depend on them.
"""

import uuid

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from reelrank.operators import explain as X
from reelrank.plans import model as MD
from reelrank.plans import q_model as QM

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    rows = QM.train_rows(spark, SF)
    # planted signal: rating follows the runtime slot (index 2)
    return rows.withColumn("rating", (F.element_at("slots", 3) % 10 + 1).cast("double"))


def test_path_attribution_is_additive(spark, planted):
    train = planted.filter(~F.col("is_test"))
    paths = MD.train(train, key=f"test-{uuid.uuid4().hex}", mode="pooled", params={"maxIter": 8})
    scored = MD.score(planted.select("user_id", "title_id", "slots", "genres"), paths)
    path = paths["*"]
    uid = PipelineModel.load(path + "/model").stages[2].uid
    nodes = X.tree_nodes(spark, f"{path}/model/stages/2_{uid}")
    c = X.path_contributions(scored, nodes)
    sums = c.groupBy("user_id", "title_id").agg(F.sum("contrib").alias("s"), F.first("base").alias("b"),
                                                F.first("walk_pred").alias("w"))
    pred = MD.predict(planted.select("user_id", "title_id", "slots", "genres"), paths) \
             .select("user_id", "title_id", "prediction")
    rows = sums.join(pred, ["user_id", "title_id"]).collect()
    assert rows
    for r in rows:
        assert r.b + r.s == pytest.approx(r.prediction, abs=1e-6)
        assert r.w == pytest.approx(r.prediction, abs=1e-6)


def test_model_beats_the_mean(spark, planted):
    train = planted.filter(~F.col("is_test"))
    test = planted.filter(F.col("is_test"))
    paths = MD.train(train, key=f"test-{uuid.uuid4().hex}", mode="per_user",
                     people=["AUTOMOBILE", "BUILDING"], params={"maxIter": 20})
    m = {r.user_id: r.mae for r in MD.evaluate(MD.predict(test, paths)).collect()}
    mu = {r.user_id: r.mu for r in train.groupBy("user_id").agg(F.avg("rating").alias("mu")).collect()}
    base = {r.user_id: r.mae for r in test.join(
        train.groupBy("user_id").agg(F.avg("rating").alias("mu")), "user_id")
        .groupBy("user_id").agg(F.avg(F.abs(F.col("rating") - F.col("mu"))).alias("mae")).collect()}
    assert set(m) == {"AUTOMOBILE", "BUILDING"} and mu
    for u in m:
        assert m[u] < base[u]
