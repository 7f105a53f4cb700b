"""Training-corpus pipeline: documents in, piece ids of the mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet and rereads it as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.llm import merge_dropout, mixing, simhash, toxicity
from reelrank.session import ensure_checkpoint_dir

# The stages rest on a trained classifier and on XXH64, which SQL lacks;
# tests/llm compares them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, trained on the labels, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of smallest id."""
    return simhash.one_per_component(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands once per pass over its source that takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, piece_ids, lossless of every row."""
    encoded = merge_dropout.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1)
    return encoded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"),
                          "piece_ids", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{base}/{n}_{name}")
        docs = spark.read.parquet(out)
    return docs
