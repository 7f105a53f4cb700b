"""Approximate nearest neighbours by a forest of random-projection trees (operator 8).

Trees are fitted on a bounded sample and sent to the executors; every vector
is indexed in one leaf of each tree.  The leaves of all trees stand in one
priority queue of a query, those first that promise the largest inner product:
that of the query and the leaf's mean vector, and three times the spread of its
vectors along a direction.  Lengths count in both, so the order is one of inner
products, not of distances.  Leaves are taken until they hold enough vectors.
Queries and vectors then meet by leaf, in blocks of bounded size, where exact
inner products rank them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship_package


@dataclass
class Forest:
    """Trees of equal depth; a tree's levels project on orthonormal
    directions, and each node cuts at its sample's median."""
    directions: list[np.ndarray]          # a tree: (dim, depth)
    cuts: list[list[np.ndarray]]          # a tree: for each level, the cut of each node

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of every vector in every tree."""
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for t, (directions, cuts) in enumerate(zip(self.directions, self.cuts)):
            projected = x @ directions
            for level, cut in enumerate(cuts):
                out[:, t] = 2 * out[:, t] + (projected[:, level] > cut[out[:, t]])
        return out


@dataclass
class Leaves:
    """What the queue knows of the leaves that hold vectors, of all trees."""
    tree: np.ndarray
    leaf: np.ndarray
    held: np.ndarray          # vectors
    mean: np.ndarray          # (leaves, dim)
    spread: np.ndarray        # root mean square distance from the mean, along one direction

    def probe(self, queries: np.ndarray, enough: float, reach: float = 3.0) -> list[np.ndarray]:
        """Places of the leaves that each query takes: in the order of the
        largest product that a leaf promises, until they hold ``enough``."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        promise = queries @ self.mean.T + reach * self.spread * length
        order = np.argsort(-promise, axis=1, kind="stable")
        before = np.cumsum(self.held[order], axis=1) - self.held[order]
        return [o[b < enough] for o, b in zip(order, before)]


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    directions, cuts = [], []
    for _ in range(trees):
        # more levels than dimensions start another orthonormal set
        sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-max(depth, 1) // dim))]
        directions.append(np.concatenate(sets, axis=1)[:, :depth])
        projected, node, own = sample @ directions[-1], np.zeros(len(sample), np.int64), []
        for level in range(depth):
            cut = np.array([np.median(p) if len(p := projected[node == n, level]) else 0.0 for n in range(1 << level)])
            node = 2 * node + (projected[:, level] > cut[node])
            own.append(cut)
        cuts.append(own)
    return Forest(directions, cuts)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vec) of the vectors that take part: an id, no null or non-finite
    component, not all zero."""
    # a float keeps its value as a double; null and NaN fail the comparison
    limit = F.lit(float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce((x > -limit) & (x < limit), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, *, trees: int = 8, sample_rows: int = 32768,
           share: float = 0.9, block_rows: int = 8192, seed: int = 1, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query.

    Nearness is the inner product of the original vectors in double
    precision; ties go to the smaller id; a query's own id is no candidate.
    ``sample_rows`` bounds the sample on which the trees are fitted;
    ``share`` is the number of vectors that a query's leaves hold in all
    trees together, as a part of all vectors (each tree holds them all once);
    they hold k + 1 vectors a tree at least, and so k candidates.

    Equal vectors are indexed once, with their k + 1 smallest ids, which are
    all that a result can hold; equal queries are searched once.

    Edge cases: vectors that are null, zero or hold null or non-finite
    components, and those not of the most frequent length, take no part,
    neither as queries; a repeated id counts once for each different vector;
    with fewer candidates than ``k`` all are returned; empty tables give no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, vec_id, embedding)
    first = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = first["dim"] if first else 0
    same = F.xxhash64("vec")
    # up to k + 1 ids of each vector: by parts first, so that no copy group meets in one task
    def fewest(c):
        return F.slice(F.sort_array(F.array_distinct(c)), 1, k + 1)
    parts = (rows.where(F.size("vec") == dim).distinct().groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
             .agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).select("vec", fewest("ids").alias("ids")))
    distinct = parts.groupBy("vec").agg(fewest(F.flatten(F.collect_list("ids"))).alias("ids"))
    distinct = checkpoint(distinct.select(F.element_at("ids", 1).alias("rep"), "ids", "vec", same.alias("h")))
    n = distinct.count()
    asked = usable(queries, vec_id, embedding).where(F.size("vec") == dim).distinct()
    asked = asked.withColumn("h", same)
    heads = checkpoint(asked.groupBy("vec", "h").agg(F.min("id").alias("head")))
    n_heads = heads.count()
    shape = "query_id long, rank int, vec_id long, score double"
    if not n or not n_heads:
        return spark.createDataFrame([], shape)

    sample = np.array([r["vec"] for r in distinct.select("vec").orderBy(F.xxhash64(F.lit(seed), "h"), "rep")
                       .limit(sample_rows).collect()], dtype=np.float64)
    # leaves of n / 128 vectors, of fewer only where a block of them would be too large
    depth = max(7, int(np.ceil(np.log2(max(n / block_rows, 1)))))
    depth = max(1, min(depth, int(np.log2(max(len(sample) / 2, 2)))))
    forest = spark.sparkContext.broadcast(fit_forest(sample, trees, depth, seed))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaves = forest.value.leaves(np.stack(pdf["vec"].to_numpy()))
                for t in range(leaves.shape[1]):
                    yield pdf[["rep", "ids", "vec"]].assign(tree=t, leaf=leaves[:, t])

    indexed = distinct.select("rep", "ids", "vec").mapInPandas(
        index, "rep long, ids array<long>, vec array<double>, tree int, leaf long")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = 1 << depth
        held, sums, squares = np.zeros(trees * width, np.int64), np.zeros((trees * width, dim)), np.zeros(trees * width)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy())
                for t, leaf in enumerate(forest.value.leaves(x).T):
                    np.add.at(sums, leaf + t * width, x)
                    held[t * width:(t + 1) * width] += np.bincount(leaf, minlength=width)
                    squares[t * width:(t + 1) * width] += np.bincount(leaf, (x * x).sum(1), width)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"tree": (at // width).astype(np.int32), "leaf": at % width, "held": held[at],
                            "sums": list(sums[at]), "squares": squares[at]})

    def total(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["held", "squares"])          # sums do not depend on the order of arrival
        return pd.DataFrame({"tree": parts["tree"][:1], "leaf": parts["leaf"][:1], "held": [parts["held"].sum()],
                             "sums": [np.stack(parts["sums"].to_numpy()).sum(0)], "squares": [parts["squares"].sum()]})

    kinds = "tree int, leaf long, held long, sums array<double>, squares double"
    # trees x leaves rows
    known = distinct.select("vec").mapInPandas(tally, kinds).groupBy("tree", "leaf").applyInPandas(total, kinds).toPandas()
    known = known.sort_values(["tree", "leaf"])
    mean = np.stack(known["sums"].to_numpy()) / known["held"].to_numpy()[:, None]
    spread = np.sqrt(np.maximum(known["squares"].to_numpy() / known["held"].to_numpy() - (mean * mean).sum(1), 0) / dim)
    leaves_known = Leaves(known["tree"].to_numpy(), known["leaf"].to_numpy(), known["held"].to_numpy(), mean, spread)
    shared = spark.sparkContext.broadcast(leaves_known)
    enough, q_blocks = max(share * n, trees * (k + 1)), -(-n_heads // 16384)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, known = np.stack(pdf["vec"].to_numpy()), shared.value
            for at in range(0, len(pdf), 128):
                taken = known.probe(x[at:at + 128], enough)
                i, place = np.repeat(np.arange(at, at + len(taken)), [len(p) for p in taken]), np.concatenate(taken)
                chunks = -(-known.held[place] // block_rows)
                chunk = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                i, place = np.repeat(i, chunks), np.repeat(place, chunks)
                yield pd.DataFrame({"head": pdf["head"].to_numpy()[i], "q": pdf["vec"].to_numpy()[i],
                                    "tree": known.tree[place], "leaf": known.leaf[place], "chunk": chunk,
                                    "q_block": pdf["head"].to_numpy()[i] % q_blocks})

    visits = heads.select("head", F.col("vec")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(
        probe, "head long, q array<double>, tree int, leaf long, chunk long, q_block long")

    def rank(vecs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vecs) and len(asks):
            v, ids, reps = np.stack(vecs["vec"].to_numpy()), vecs["ids"].tolist(), vecs["rep"].to_numpy()
            by_id = np.argsort(reps)
            v, reps, ids = v[by_id], reps[by_id], [ids[i] for i in by_id]
            kth, longest = max(0, len(v) - k - 1), np.linalg.norm(v, axis=1).max()
            for at in range(0, len(asks), 512):
                q = np.stack(asks["q"].to_numpy()[at:at + 512])
                block = q @ v.T
                # all that may be among the first k + 1, however many tie there: block products are rounded
                slack = 4 * q.shape[1] * np.finfo(float).eps * longest * np.linalg.norm(q, axis=1)
                row, which = np.nonzero(block >= (np.partition(block, kth, axis=1)[:, kth] - slack)[:, None])
                exact = np.einsum("cd,cd->c", v[which], q[row])
                order = np.lexsort((which, -exact, row))
                ends = np.searchsorted(row[order], np.arange(len(q) + 1))
                for head, a, b in zip(asks["head"].to_numpy()[at:at + 512], ends, ends[1:]):
                    some = order[a:b]
                    # of a vector's equals the k + 1 smallest ids are known; vectors that tie share their places
                    near = sorted((-s, i) for w, s in zip(which[some].tolist(), exact[some].tolist()) for i in ids[w])[:k + 1]
                    out.append((head, [{"far": f, "id": i} for f, i in near]))
        return pd.DataFrame(out, columns=["head", "near"])

    block = ["tree", "leaf", "chunk", "q_block"]
    # leaves of more than a block; at most trees x leaves
    large = known[known["held"] > block_rows]
    pieces = spark.createDataFrame([(int(t), int(leaf), int(-(-h // block_rows))) for t, leaf, h in
                                    zip(large["tree"], large["leaf"], large["held"])], "tree int, leaf long, pieces long")
    dealt = indexed.join(F.broadcast(pieces), ["tree", "leaf"], "left").withColumns({
        "chunk": F.pmod(F.xxhash64("rep"), F.coalesce("pieces", F.lit(1).cast("long"))),
        "q_block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))}).drop("pieces")
    met = dealt.groupBy(*block).cogroup(visits.groupBy(*block)).applyInPandas(
        rank, "head long, near array<struct<far:double,id:long>>")
    # at most trees x leaves lists of k + 1 for a query
    best = met.groupBy("head").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("all"))
    # a vector met in several trees stands several times, side by side
    best = best.select("head", F.slice(F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))), 1, k + 1)
                       .alias("near"))
    named = asked.join(heads.withColumnRenamed("vec", "_vec"), (F.col("vec") == F.col("_vec")) & (asked.h == heads.h)).select(
        F.col("id").alias("query_id"), "head")
    return (named.join(best, "head")
            .select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k))
                    .alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"),
                    (-F.col("x.far")).alias("score")))
