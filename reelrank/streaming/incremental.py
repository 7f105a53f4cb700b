"""Resumable incremental jobs on Structured Streaming (K1, K2).

The application processes "what is missing", saves every N rows and carries
on the next day.  Here the file source's checkpoint replaces the counters:

* K1 ``incremental_enrich``: new reply files -> flatten (A2) -> de-duplicate
  inside the batch (E2) -> drop ids already stored (C4) -> append (G7, first
  wins).  The table is a bucket store (``store.py``): a batch reads only the
  buckets that may hold its ids.
* K2 ``incremental_score``: the same batch scores the new titles for everyone
  and merges them into the catalog (G4), another bucket store, of which only
  the touched buckets are written anew.

A store remembers the last batch it took, so a batch replayed after a failure
changes nothing and passes on the same rows: the result equals a single run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import dedupe
from ..sources.ingest import flatten_metadata
from .store import BucketStore

REPLY_FILE_SCHEMA = T.StructType([T.StructField("title_id", T.LongType()),
                                  T.StructField("reply", T.StringType()),
                                  T.StructField("_ord", T.LongType())])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(prefix):
            fs2, done = _fs(spark, st.getPath().toString() + "/_SUCCESS")
            if fs2.exists(done):
                out.append(int(name[len(prefix):]))
    return sorted(out)


def read_stored(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """All rows of the newest version of a stored table."""
    return BucketStore(spark, table_dir).rows()


def enrich_batch(batch: DataFrame, batch_id: int, table_dir: str) -> DataFrame:
    """K1 body for one micro-batch; returns the rows it stored."""
    flat = flatten_metadata(batch, keep=("title_id", "_ord"))
    flat = flat.filter(F.col("title_id").isNotNull())
    return BucketStore(batch.sparkSession, table_dir).add_missing(dedupe(flat, "title_id", "_ord", keep="first"), batch_id)


def incremental_enrich(spark: SparkSession, input_dir: str, table_dir: str, checkpoint_dir: str,
                       catalog_dir: str | None = None,
                       scorer: Callable[[DataFrame], DataFrame] | None = None,
                       files_per_batch: int = 1000) -> None:
    """Run K1 (and K2 when ``catalog_dir`` and ``scorer`` are given) over
    every file not yet processed, then stop (``availableNow``).

    A batch holds ``files_per_batch`` files at most."""
    stream = (spark.readStream.schema(REPLY_FILE_SCHEMA)
                   .option("maxFilesPerTrigger", files_per_batch).parquet(input_dir))

    def body(batch: DataFrame, batch_id: int) -> None:
        stored = enrich_batch(batch, batch_id, table_dir)
        if catalog_dir is not None and scorer is not None:
            incremental_score_batch(stored, batch_id, catalog_dir, scorer)

    q = (stream.writeStream.foreachBatch(body)
               .option("checkpointLocation", checkpoint_dir)
               .trigger(availableNow=True).start())
    q.awaitTermination()


def incremental_score_batch(new_titles: DataFrame, batch_id: int, catalog_dir: str,
                            scorer: Callable[[DataFrame], DataFrame]) -> None:
    """K2 body: score the new titles and merge them into the catalog (G4: a
    title's new rows replace its old ones)."""
    BucketStore(new_titles.sparkSession, catalog_dir).upsert(scorer(new_titles), batch_id)
