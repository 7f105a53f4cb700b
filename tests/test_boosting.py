"""Histogram boosting: against a plain grower, over any number of tasks, and
its explanations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelrank.operators import boosting as B

PARAMS = {"rounds": 6, "rate": 0.3, "depth": 3, "least": 4, "l2": 0.5}


def table(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 5, n), np.full(n, 3.0), rng.normal(size=n)])
    y = 3 + np.where(x[:, 0] > 0.2, 2.0, 0.0) * x[:, 1] + 0.3 * x[:, 2] + 0.05 * rng.normal(size=n)
    key = rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1])
    return x, np.round(y, 3), key


def plain_forest(x, y, p):
    """One split at a time over plain values; returns the predictions."""
    f = np.full(len(y), y.mean())
    for _ in range(p["rounds"]):
        g = y - f
        new = f.copy()

        def grow(rows, depth):
            best = (1e-9, None, None)
            total, n = g[rows].sum(), len(rows)
            if depth < p["depth"]:
                for j in range(x.shape[1]):
                    for v in np.unique(x[rows, j])[:-1]:
                        left = x[rows, j] <= v
                        nl = left.sum()
                        if min(nl, n - nl) < p["least"]:
                            continue
                        gl = g[rows][left].sum()
                        gain = gl ** 2 / (nl + p["l2"]) + (total - gl) ** 2 / (n - nl + p["l2"]) - total ** 2 / (n + p["l2"])
                        if gain > best[0] + 1e-9:
                            best = (gain, j, v)
            if best[1] is None:
                new[rows] = f[rows] + p["rate"] * total / (n + p["l2"])
                return
            left = x[rows, best[1]] <= best[2]
            grow(rows[left], depth + 1)
            grow(rows[~left], depth + 1)
        grow(np.arange(len(y)), 0)
        f = new
    return f


@pytest.fixture(scope="module")
def data(spark):
    x, y, key = table()
    rows = spark.createDataFrame([(str(k), i, [float(v) for v in r], float(t)) for i, (k, r, t) in enumerate(zip(key, x, y))],
                                 "key string, id long, x array<double>, y double")
    edges = [sorted(set(x[:, j]))[:-1] for j in range(x.shape[1])]
    return rows, x, y, key, [e[:255] for e in edges]


def test_splits_are_the_best(spark, data):
    """With a bin for each value the trees are those of a plain search."""
    rows, x, y, key, _ = data
    for k in "abc":
        mine = key == k
        small = mine & (np.cumsum(mine) <= 60)
        edges = [sorted(set(x[small, j]))[:-1] for j in range(x.shape[1])]
        g = B.Grower(B.binned(x[small], edges), edges, np.zeros(small.sum(), int), 1, y[small], PARAMS)
        list(g.grow(np.array(["k"]), 0, PARAMS["rounds"]))
        assert g.f == pytest.approx(plain_forest(x[small], y[small], PARAMS), abs=1e-9)


@pytest.mark.parametrize("rows_a_task, batch_rows", [(1000, 20_000), (1000, 10), (90, 20_000), (60, 50)])
def test_any_number_of_tasks(spark, data, rows_a_task, batch_rows):
    """Keys in one task or over several, alone or in batches: the same trees."""
    rows, x, y, key, edges = data
    nodes = B.fit(rows, key="key", label="y", order="id", edges=edges, rows_a_task=rows_a_task, batch_rows=batch_rows, **PARAMS)
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)
    got = {r.id: r.prediction for r in B.predict(rows, nodes, keep=["id"], key="key", block_rows=37).collect()}
    for k in "abc":
        mine = np.flatnonzero(key == k)
        one = B.Grower(B.binned(x[mine], edges), edges, np.zeros(len(mine), int), 1, y[mine], PARAMS)
        list(one.grow(np.array(["k"]), 0, PARAMS["rounds"]))
        assert [got[i] for i in mine] == pytest.approx(one.f.tolist(), abs=1e-9)


def test_stages_go_on(spark, data):
    """Three rounds and three more are six rounds."""
    rows, *_, edges = data
    half = {**PARAMS, "rounds": 3}

    def held(df):
        return spark.createDataFrame(df.collect(), df.schema)
    whole = held(B.fit(rows, key="key", label="y", order="id", edges=edges, **PARAMS))
    one = held(B.fit(rows, key="key", label="y", order="id", edges=edges, **half))
    begun = B.predict(rows, one, keep=["key", "id", "x", "y"], key="key")
    two = held(B.fit(begun, key="key", label="y", order="id", edges=edges, first=3, begin="prediction", **half))
    a, b = ({(r.key, r.tree, r.node): (r.feature, r.threshold, round(r.value, 9)) for r in d.collect()}
            for d in (whole, one.unionByName(two)))
    assert a == b


def test_explanations(spark, data):
    rows, x, y, key, edges = data
    fitted = B.fit(rows.where("key <> 'c'"), key="key", label="y", order="id", edges=edges, rows_a_task=90, **PARAMS)
    nodes = spark.createDataFrame(fitted.collect(), fitted.schema)
    got = B.explain(rows, nodes, keep=["id", "key"], key="key", block_rows=50).collect()
    pred = {r.id: r.prediction for r in B.predict(rows, nodes, keep=["id"], key="key").collect()}
    assert {r.id for r in got} == {i for i in range(len(y)) if key[i] != "c"}
    assert all(pred[i] is None for i in range(len(y)) if key[i] == "c")
    total = {}
    for r in got:
        assert r.value == x[r.id][r.feature_index]
        total[r.id] = total.get(r.id, r.base) + r.contrib
        assert r.walk_pred == pytest.approx(pred[r.id], abs=1e-9)
    for i, t in total.items():
        assert t == pytest.approx(pred[i], abs=1e-9)
    # the leaf table says the same
    leaf = B.leaf_credits(nodes).groupBy("key", "feature").agg(F.count("*").alias("n")).collect()
    assert {(r.key, r.feature) for r in leaf} >= {(r.key, r.feature_index) for r in got if r.contrib}


def test_edges(spark):
    rows = spark.createDataFrame([([float(i), float(i % 2), 1.0],) for i in range(1000)], "x array<double>")
    edges = B.bin_edges(rows, bins=8)
    assert edges[1] == [0.0] and edges[2] == [] and 0 < len(edges[0]) <= 7
    empty = spark.createDataFrame([], "key string, id long, x array<double>, y double")
    assert B.fit(empty, key="key", label="y", order="id", rounds=2).count() == 0


def test_a_level_of_a_wide_key_costs_no_waits(spark, data):
    """A barrier stage's gather waits a second, one a level."""
    import time
    rows, *_, edges = data
    begun = time.time()
    p = {**PARAMS, "rounds": 30}
    assert B.fit(rows, key="key", label="y", order="id", edges=edges, rows_a_task=90, **p).where("tree = 29").count()
    assert time.time() - begun < 60


def test_joint_codes_hold_every_feature():
    rng = np.random.default_rng(1)
    sizes = np.array([2, 1, 30, 64, 2, 2, 3, 256])
    x = np.column_stack([rng.integers(0, n, 500) for n in sizes]).astype(np.uint8)
    joint, node, g = B.Joint(sizes), rng.integers(0, 3, 500), rng.normal(size=500)
    codes = joint.codes(x)
    for f in np.flatnonzero(sizes > 1):
        assert (joint.bins(codes, np.arange(500), np.full(500, f)) == x[:, f]).all()
    sums, counts = joint.histograms([(codes[:, a:a + 250], np.arange(250), node[a:a + 250], g[a:a + 250]) for a in (0, 250)], 3)
    plain = B.Grower(x, [[0.0] * (n - 1) for n in sizes], np.zeros(500, int), 1, g, PARAMS).histograms(np.arange(500), node, 3, g)
    assert sums == pytest.approx(plain[0], abs=1e-9) and (counts == plain[1]).all()


def jobs_of(spark, work):
    group = f"jobs-{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_wide_keys_grow_in_one_job(spark, data, monkeypatch):
    """Tasks that can run at once keep their rows for all rounds; the trees are those of a job a level."""
    rows, *_, edges = data

    def trees():
        fitted = B.fit(rows, key="key", label="y", order="id", edges=edges, rows_a_task=90, **PARAMS).collect()
        return {(r.key, r.tree, r.node): (r.feature, r.threshold, r.left, r.n, round(r.value, 9)) for r in fitted}
    together, jobs = jobs_of(spark, trees)
    assert jobs < PARAMS["rounds"] * PARAMS["depth"]
    monkeypatch.setattr(B, "_slots", lambda spark: 0)
    assert together == trees()


def test_sums_over_tasks(tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    values = np.random.default_rng(3).normal(size=(3, 4, 50))

    def task(rank):
        together = B.Together(str(tmp_path / "sums"), rank, 3)
        return [together.is_slow(), *(together.total(v[:n]) for v, n in zip(values[rank], (50, 1, 0, 49)))]
    with ThreadPoolExecutor(3) as pool:
        found = [*pool.map(task, range(3))]
    for slow, *sums in found:
        assert not slow
        for i, n in enumerate((50, 1, 0, 49)):
            assert sums[i] == pytest.approx(values[:, i, :n].sum(0), abs=1e-12)


def test_edges_of_many_values_lie_at_the_ranks(spark):
    """Of more values than a task keeps, dealt unevenly: each edge's rank is off by a two-thousandth at most."""
    n = 60_000
    values = F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.pow(F.rand(5), F.lit(3.0)))
    rows = spark.range(n).select(F.array(values, F.col("id").cast("double")).alias("x")).repartitionByRange(5, F.col("x")[1]).persist()
    edges = B.bin_edges(rows)
    x = np.array([r.x for r in rows.collect()])
    rows.unpersist()
    ranks = B.Ranks(100)
    for part in np.array_split(x[:, 0], 50):
        ranks.add(part)
    v, some = np.sort(x[:, 0]), ranks.end()
    off = np.cumsum(some[1]) - np.searchsorted(v, some[0], "right")
    assert len(some[0]) <= 202 and len(ranks.levels) > 2 and some[1].sum() == n and np.abs(off).max() <= n / 100
    for f, e in enumerate(edges):
        v, want = np.sort(x[:, f]), np.arange(1, 63) / 64
        low, high = np.searchsorted(v, e, "left") / n, np.searchsorted(v, e, "right") / n
        for share in want:
            assert ((low - 1 / 2000 <= share) & (share <= high + 1 / 2000)).any()
