"""Trained text vectors (I2): a distributed randomised SVD of the TF-IDF matrix.

Words are hashed to ``width`` columns.  Two passes over the texts find the
leading right singular vectors V: the first maps a random block through A'A,
the second refines it (Rayleigh-Ritz).  A pass keeps a width x rank matrix a
task, sends it by blocks of rows, and the driver factors their sum, whose size
does not depend on the texts.  A text's vector is its row of A V, of unit length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

WORD = re.compile(r"\w\w+")
BLOCK = 256          # rows of the matrix that travel together


def _columns(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns of a text's words, ascending, and their counts."""
    from zlib import crc32
    words = WORD.findall((text or "").lower())
    return np.unique(np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % width for w in words), np.int64, len(words)),
                     return_counts=True)


def _row(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's columns and weights, of unit length."""
    at, n = _columns(text, len(idf))
    w = (1 + np.log(n)) * idf[at] if len(at) else np.empty(0)
    length = np.sqrt((w * w).sum())
    return at, w / length if length else w


def _total(df: DataFrame, text: str, of_batch: Callable[[list[str | None], np.ndarray], None], width: int, rank: int) -> np.ndarray:
    """Sum over all tasks of the width x rank matrices that ``of_batch`` adds to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, rank))
        for batch in batches:
            of_batch(batch.column(0).to_pylist(), total)
        blocks = [i for i in range(0, width, BLOCK) if total[i:i + BLOCK].any()]
        for i in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i:i + BLOCK].tobytes()], pa.binary())],
                                             ["block", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        # in the order of their bytes, so that the sum does not depend on who came first
        return pd.DataFrame({"block": parts["block"][:1], "part": [sum(np.frombuffer(p) for p in sorted(parts["part"])).tobytes()]})
    kind = "block int, part binary"
    out = np.zeros((width, rank))
    # width / BLOCK rows
    for r in df.select(text).mapInArrow(run, kind).groupBy("block").applyInPandas(add, kind).collect():
        out[r["block"]:r["block"] + BLOCK] = np.frombuffer(r["part"]).reshape(-1, rank)
    return out


def fit_svd(df: DataFrame, text: str, dim: int = 384, *, width: int = 1 << 13, extra: int = 16, seed: int = 42,
            ) -> tuple[np.ndarray, np.ndarray]:
    """(idf, V): weights of the hashed columns, and ``dim`` orthonormal
    directions over them.  Null and wordless texts count for nothing."""
    spark = df.sparkSession
    ship_package(spark)
    rank = dim + extra

    def count(texts, total):
        for t in texts:
            total[_columns(t, width)[0], 0] += 1
            total[0, 1] += 1
    seen = _total(df, text, count, width, 2)
    idf = np.log((1 + seen[0, 1]) / (1 + seen[:, 0])) + 1
    shared = spark.sparkContext.broadcast(idf)

    def through(basis):
        """A'A times the basis."""
        block = spark.sparkContext.broadcast(basis)

        def add(texts, total):
            for t in texts:
                at, w = _row(t, shared.value)
                total[at] += np.outer(w, w @ block.value[at])
        return _total(df, text, add, width, rank)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank)))[0]
    basis = np.linalg.qr(through(basis))[0]
    values, turn = np.linalg.eigh((lambda t: (t + t.T) / 2)(basis.T @ through(basis)))
    return idf, basis @ turn[:, ::-1][:, :dim]


def embed_svd(df: DataFrame, text: str, model: tuple[np.ndarray, np.ndarray], out_col: str = "vec") -> DataFrame:
    """``df`` with ``out_col``: array<float> of unit length, all zero for null
    and wordless texts."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        idf, directions = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                at, w = _row(t, idf)
                v = w @ directions[at]
                length = np.sqrt((v * v).sum())
                rows.append((v / length if length else v).astype(np.float32))
            yield pd.Series(rows)
    return df.withColumn(out_col, embed(F.col(text)))
