"""Token counts of flat, unindexed token files (operator 3).

A flat file is a run of little-endian unsigned ids of two or four bytes,
documents ended by a separator id, and nothing else.  Files are read in blocks of fixed size, on
any executor and in any order; a vectorised search finds the separators of a
block.  A document may span blocks: a prefix scan over the blocks' summaries
carries the last separator and the document count across block boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, ship_package
from .token_files import in_chunks, worker_encoder

BLOCK = 1 << 20     # ids in a block
KINDS = {2: "<u2", 4: "<u4"}     # by the bytes of an id


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_flat_files(docs: DataFrame, folder: str, tokenizer_file: str, separator: int, *, width: int = 4,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs``, as they stand in their partitions, to a flat file each.

    One row per document: part, ordinal (in the file), doc_id, path (of the
    file, in the row of its first document only).  ``width`` is the bytes of
    an id; two hold a vocabulary of up to 65,536.

    ``folder`` must be shared by all executors.  A task writes a file of its
    own name, so that a repeated task cannot disturb the first one's file;
    the checkpointed rows name the files that count.  Null and empty texts
    hold the separator alone.
    """
    spark = docs.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(tokenizer_file)
    name = tokenizer_file.rsplit("/", 1)[-1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = worker_encoder(SparkFiles.get(name), separator)
        part, ordinal = TaskContext.get().partitionId(), 0
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tokens"
        store, inside = _open(path)
        store.create_dir(inside.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inside) as out:
            for whole in batches:
                for batch in in_chunks(whole, "text", 4 << 20):
                    ids, _ = encode_texts(batch.column("text").to_pylist())
                    if width == 2 and len(ids) and ids.max() > 0xFFFF:
                        raise ValueError("an id needs more than two bytes")
                    out.write(ids.astype(KINDS[width], copy=False).tobytes())
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(ordinal, ordinal + n)),
                         batch.column("doc_id"), pa.array([path if ordinal + i == 0 else None for i in range(n)], pa.string())],
                        ["part", "ordinal", "doc_id", "path"])
                    ordinal += n

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return checkpoint(texts.mapInArrow(
        write, "part int, ordinal long, doc_id long, path string"))


def scan_flat_files(files: DataFrame, separator: int, block: int = BLOCK, width: int = 4) -> DataFrame:
    """Documents of flat files; ``files`` holds part (order) and path, one row
    each (rows without a path are passed over).

    Columns: part, ordinal (in its file), start (ids before it in its file),
    n_tokens (with the separator), ended (false for ids after a file's last
    separator).  An empty file has no document; consecutive separators are
    documents of one id; bytes after the last whole id are ignored.
    """
    spark = files.sparkSession
    ship_package(spark)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                store, inside = _open(path)
                found.append(store.get_file_info(inside).size // width)
            yield batch.append_column("ids", pa.array(found, pa.int64()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inside = _open(row["path"])
                begin = row["block"] * block
                with store.open_input_file(inside) as f:
                    data = f.read_at(width * min(block, row["ids"] - begin), width * begin)
                at = begin + np.flatnonzero(np.frombuffer(data, KINDS[width]) == separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int64()),
                     pa.array([row["ids"]], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                    ["part", "block", "ids", "ends"])

    listed = files.where("path is not null").select(F.col("part").cast("int").alias("part"), "path")
    sized = listed.mapInArrow(sizes, "part int, path string, ids long").where("ids > 0")
    blocks = sized.withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block).cast("long"))))
    found = checkpoint(blocks.repartition("part", "block").mapInArrow(
        search, "part int, block long, ids long, ends array<long>"))
    # the scan: what each block takes over from those before it in its file
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("part", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = summary.select("part", "block",
                             F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("documents"),
                             F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("end"))
    whole = (found.join(carried, ["part", "block"])
             .select("part", "documents", "end", "ends", F.posexplode("ends").alias("i", "at"))
             .select("part", (F.col("documents") + F.col("i")).alias("ordinal"),
                     (F.when(F.col("i") == 0, F.col("end")).otherwise(F.get("ends", F.col("i") - 1)) + 1).alias("start"),
                     "at")
             .select("part", "ordinal", "start", (F.col("at") - F.col("start") + 1).alias("n_tokens"),
                     F.lit(True).alias("ended")))
    rest = (found.groupBy("part").agg(F.max("ids").alias("ids"), F.sum(F.size("ends")).alias("ordinal"),
                                      F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))) + 1, F.lit(0)).alias("start"))
            .where("start < ids")
            .select("part", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"),
                    F.lit(False).alias("ended")))
    return whole.union(rest)
