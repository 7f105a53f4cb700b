"""Text vectors: orthonormal directions, the exact SVD's subspace, retrieval."""

import numpy as np
import pytest

from reelrank.operators import text_vectors as T
from reelrank.plans import model as MD

TOPICS = ["ship sea sailor storm harbour island", "court judge lawyer verdict witness trial",
          "robot planet orbit engine galaxy signal", "horse ranch dust rifle saloon sheriff"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        words = TOPICS[i % 4].split()
        said = [*rng.choice(words, 4), *(f"w{x}" for x in rng.integers(0, 400, 10))]
        rows.append((i, " ".join(said), i % 4))
    return spark.createDataFrame([*rows, (900, None, 0), (901, " .", 0)], "id long, text string, topic int").repartition(5)


def test_directions(spark, docs):
    idf, v = T.fit_svd(docs, "text", dim=32, width=1024)
    assert np.abs(v.T @ v - np.eye(32)).max() < 1e-6
    a = np.zeros((240, 1024))
    for k, r in enumerate(docs.where("id < 240").collect()):
        at, w = T._row(r.text, idf)
        a[k, at] = w
    exact = np.linalg.svd(a)[1]
    found = np.linalg.norm(a @ v, axis=0)
    assert found[:4] == pytest.approx(exact[:4], rel=0.05), (found[:6], exact[:6])
    assert (found ** 2).sum() > 0.8 * (exact[:32] ** 2).sum()


def nearest_share(rows):
    rows = [r for r in rows if r.id < 240]
    x, topic = np.array([r.vec for r in rows]), np.array([r.topic for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, -1)
    return (topic[np.argsort(-s, axis=1)[:, :5]] == topic[:, None]).mean()


def test_retrieval_beats_hashing(spark, docs):
    trained = T.embed_svd(docs, "text", T.fit_svd(docs, "text", dim=16, width=4096)).collect()
    hashed = MD.embed_text(docs.na.fill("", ["text"]), "text", dim=16).collect()
    assert nearest_share(trained) > nearest_share(hashed) + 0.1
    for r in trained:
        assert np.linalg.norm(r.vec) == pytest.approx(1 if r.id < 240 else 0, abs=1e-5)
