"""Toxicity by multiple-instance learning (operator 6).

A document is a bag of sentences.  A sentence's score is a logistic model of
its hashed words and word prefixes; a document is toxic unless none of its
sentences is (noisy-or): P = 1 - prod(1 - p_s).  Only documents carry labels,
so the sentence model is trained through the noisy-or, and afterwards points
at the sentences that offend.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship_package
from .names import free_prefix

BUCKETS = 1 << 18          # hashed features; the model has a float for each telling one
PREFIXES = (4, 5, 6)       # bytes; prefixes let inflected forms share weight
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"\w+")


def _features(word: str) -> list[int]:
    b = word.encode("utf-8", "surrogatepass")
    crc = zlib.crc32
    return [crc(b, 1) % BUCKETS, *[crc(b[:n]) % BUCKETS for n in PREFIXES if len(b) >= n]]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) code points of the sentences of a text that hold a word."""
    return [m.span() for m in SENTENCE.finditer(text or "") if WORD.search(m.group())]


@dataclass
class Model:
    weights: dict[int, float]      # by bucket; those left out weigh 0
    bias: float


class WordWeights(dict):
    """Weight of a word, remembered for at most ``room`` words."""

    def __init__(self, model: Model, room: int = 500_000):
        super().__init__()
        self.weights, self.room = model.weights, room

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        x = sum([get(f, 0.0) for f in _features(word)])
        if len(self) < self.room:
            self[word] = x
        return x


def telling_features(bags: list[np.ndarray], y: np.ndarray, least: int = 3, g2: float = 15.0) -> np.ndarray:
    """Buckets whose presence depends on the document label: in ``least``
    documents or more, with a likelihood-ratio statistic of ``g2`` or more."""
    with_bad, with_all = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bag, bad in zip(bags, y):
        with_all[bag] += 1
        with_bad[bag] += bad
    n, bad = len(y), y.sum()

    def part(seen, expected):
        return seen * np.log(np.where(seen > 0, seen / np.maximum(expected, 1e-9), 1.0))

    good = with_all - with_bad
    stat = 2 * (part(with_bad, with_all * bad / n) + part(good, with_all * (n - bad) / n)
                + part(bad - with_bad, (n - with_all) * bad / n)
                + part(n - bad - good, (n - with_all) * (n - bad) / n))
    return np.flatnonzero((with_all >= least) & (stat >= g2))


def fit(texts: list[str], labels: list[int], rounds: int = 300, l2: float = 1e-3,
        rate: float = 0.1) -> Model:
    """Choose telling features, then fit by Adam on the document likelihood.

    Sentences without a telling feature all score the bias, so each document
    keeps their number only.
    """
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return Model({}, -8.0)
    number: dict[str, int] = {}
    bodies = []                              # a document: its words, and where each sentence ends
    for text in texts:
        words, ends = [], []
        for a, b in sentences(text):
            words += [number.setdefault(w, len(number)) for w in WORD.findall(text[a:b].lower())]
            ends.append(len(words))
        bodies.append((np.array(words, np.int32), np.array(ends, np.int32)))
    features = np.full((len(number), 1 + len(PREFIXES)), -1, np.int32)
    for i, w in enumerate(number):
        f = _features(w)
        features[i, :len(f)] = f
    del number
    bags = [np.unique(f[f >= 0]) for f in (features[np.unique(words)] for words, _ in bodies)]
    chosen = telling_features(bags, y)
    column = np.full(BUCKETS + 1, -1, np.int32)          # the last for "no feature"
    column[chosen] = np.arange(len(chosen))
    hits = column[features]
    index, sentence_of, doc_of, plain, n = [], [], [], np.zeros(len(y)), 0
    for d, (words, ends) in enumerate(bodies):
        found = hits[words]
        at, which = np.nonzero(found >= 0)
        sentence, inside = np.unique(np.searchsorted(ends, at, "right"), return_inverse=True)
        index.append(found[at, which])
        sentence_of.append(n + inside)
        doc_of.append(np.full(len(sentence), d))
        plain[d] = len(ends) - len(sentence)
        n += len(sentence)
    index, sentence_of, doc_of = map(np.concatenate, (index, sentence_of, doc_of))
    k, w, bias = len(chosen), np.zeros(len(chosen)), -8.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence_of, w[index], n)
        risk = np.bincount(doc_of, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, bias)   # -log(1 - P)
        slope = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(risk, 50)), 1e-6), 1.0) / len(y)
        g = slope[doc_of] * _logistic(z)
        grad = np.append(np.bincount(index, g[sentence_of], k) + l2 * w / np.sqrt(len(y)),
                         g.sum() + (slope * plain).sum() * _logistic(bias))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(dict(zip(chosen.tolist(), w.tolist())), float(bias))


def _logistic(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def score(text: str | None, model: Model, known: WordWeights, threshold: float = 0.5,
          ) -> tuple[float, list[tuple[int, int, float]]]:
    """Probability that a text is toxic, and the sentences (start, end, p) of
    at least ``threshold``."""
    weigh, words_of, risk, found = known.__getitem__, WORD.findall, 0.0, []
    for m in SENTENCE.finditer(text or ""):
        if words := words_of(m.group().lower()):
            z = max(-700.0, min(700.0, model.bias + sum(map(weigh, words))))
            risk += z if z > 40 else math.log1p(math.exp(z))
            p = 1 / (1 + math.exp(-z))
            if p >= threshold:
                found.append((*m.span(), p))
    return -math.expm1(-risk), found


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, seed: int = 1,
          doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``docs`` that are not held
    out, those with the smallest seeded hash of their id (all, if there are fewer).

    Labels without a document do not count.  Rows with a null label, id or
    text are left out; a repeated label row counts once, repeated documents
    each time.  Without rows of both labels, as in empty tables, every sentence
    scores the same low value.
    """
    marked = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
              .where(~is_held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
              .withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30))))
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).dropna()
    # at most max_rows ids go to the scan of the texts, and at most max_rows of its rows to the driver
    marked = checkpoint(marked.join(found.select("_id").distinct(), "_id", "left_semi").orderBy("_at", "_id").limit(max_rows))
    rows = found.join(F.broadcast(marked), "_id").orderBy("_at", "_id", "_text").limit(max_rows).select("_text", "_y").toArrow()
    return fit(rows["_text"].to_pylist(), rows["_y"].to_pylist())


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5,
                    score_col: str = "score", spans_col: str = "offending") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``: array of (start,
    end, score) of the sentences that score at least ``threshold`` alone.

    Whole texts are scored.  Null, empty and wordless texts have score 0 and
    no sentence; repeated rows repeat their score; an empty table gives no
    rows.  Existing columns of these names are replaced, all others kept.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)        # BUCKETS floats at most
    kind = f"{score_col} double, {spans_col} array<struct<start:int,end:int,score:double>>"

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordWeights(shared.value)
        for texts in batches:
            rows = [score(t, shared.value, known, threshold) for t in texts]
            yield pd.DataFrame({
                score_col: [p for p, _ in rows],
                spans_col: [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in rows]})

    both = free_prefix(docs, "_scored_")
    out = docs.withColumn(both, scored(F.col(text)))
    return out.withColumns({c: F.col(both)[c] for c in (score_col, spans_col)}).drop(both)


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with the same columns."""
    mark = free_prefix(docs, "_tox_")
    scored = score_documents(docs, model, text=text, threshold=threshold, score_col=mark + "score", spans_col=mark + "spans")
    return scored.where(F.col(mark + "score") < threshold).select(*docs.columns)
