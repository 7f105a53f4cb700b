"""Token-ID files as Parquet list columns (operator 9).

Documents are range-sorted by id and encoded in that order; each partition
writes a file of one row per document.  Token lists are dictionary-encoded
(ids of a 50k vocabulary pack into 16 bits), the ascending columns
delta-encoded; row groups and pages are small enough, and indexed, for reading
one document or the metadata alone.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

PARQUET = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000", "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false", "parquet.enable.dictionary#n_tokens": "false",
}
SLICE = 8 << 20            # bytes of text encoded at once: its different words are looked up once
AT_ONCE = 1 << 14          # new words given to the library in a call, whose result takes far more room than the ids
SEPARABLE = re.compile(r"(?= \S)")
SPACE_RUN = re.compile(r" \s")
_ENCODERS: dict[tuple[str, int], Callable] = {}          # of this worker process, which serves many tasks


def worker_encoder(tokenizer_file: str, end_id: int) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """:func:`encoder`, made once per worker process."""
    if (tokenizer_file, end_id) not in _ENCODERS:
        _ENCODERS[tokenizer_file, end_id] = encoder(tokenizer_file, end_id)
    return _ENCODERS[tokenizer_file, end_id]


class Remembered(dict):
    """Values by unit.  Over ``room`` units, those not used since the last such
    time are forgotten."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.older = room, {}

    def missing(self, units: Iterable[str]) -> list[str]:
        """Units whose values must be made; older ones are taken over."""
        if len(self) > self.room:
            self.older = dict(self)
            self.clear()
        new = set(units).difference(self)
        back = new.intersection(self.older)
        self.update(zip(back, map(self.older.__getitem__, back)))
        return list(new.difference(back))


def byte_of_char() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes
    stand for themselves, the others for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


def is_separable(tokenizer) -> bool:
    """Whether the tokenizer always cuts before a space that no white space follows."""
    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}
    return bool(before.get("type") == "ByteLevel" and before.get("use_regex", True)
                and not before.get("add_prefix_space") and not spec.get("normalizer"))


def encode_words(tokenizer, sizes: np.ndarray, words: list[str], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a space and each word, end to end, and where each word's end.

    Words hold no space and do not begin with white space, so a separable
    tokenizer cuts between them: many are encoded as one text, and its ids
    are dealt by the byte ``sizes`` of the tokens.
    """
    joined = [" " + " ".join(words[i:i + together]) for i in range(0, len(words), together)]
    found = [e.ids for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
    ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
    ends = np.cumsum(sizes[ids])
    word_ends = np.cumsum([1 + (len(w) if w.isascii() else len(w.encode())) for w in words])
    cuts = np.searchsorted(ends, word_ends) + 1
    if len(words) and not np.array_equal(ends[cuts - 1], word_ends):
        raise ValueError("the tokenizer merges across its cuts")
    return ids, cuts


class Numbered:
    """Numbers of units, and their ids end to end in one array.  Number 0 is
    the end of a document.  ``after`` numbers words behind a space, ``alone``
    other units.  Over ``room`` units, those that one call alone has used are
    forgotten; at most half the room is kept, the units used most."""

    def __init__(self, end_id: int, room: int):
        self.end_id, self.room = end_id, room
        self.forget()

    def forget(self) -> None:
        self.after, self.alone = {}, {}
        self.ids, self.begins = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)           # calls that used a unit
        self.n = 0
        self.add([self.end_id], [1])

    def full(self) -> bool:
        return self.n > self.room

    def use(self, numbers: np.ndarray) -> None:
        """One more call uses these units, however often they stand in it."""
        self.uses[numbers] += 1

    def forget_rare(self) -> None:
        """Uses are halved, so that a unit no longer met goes next time."""
        uses, half = self.uses[1:self.n], self.room // 2
        least = 2
        if np.count_nonzero(uses >= least) > half:
            least = int(np.partition(uses, len(uses) - 1 - half)[len(uses) - 1 - half]) + 1
        kept = 1 + np.flatnonzero(uses >= least)
        sizes = self.sizes(kept)
        ids, uses = self.joined(kept, sizes), self.uses[kept] // 2
        numbers = np.zeros(self.n, np.int64)
        numbers[kept] = np.arange(1, len(kept) + 1)
        number = numbers.tolist()
        after, alone = ({u: number[at] for u, at in units.items() if number[at]} for units in (self.after, self.alone))
        self.forget()
        self.after, self.alone = after, alone
        self.add(ids, np.cumsum(sizes))
        self.uses[1:self.n] = uses

    @staticmethod
    def _with_room(values: np.ndarray, n: int) -> np.ndarray:
        if n <= len(values):
            return values
        wider = np.zeros(max(n, len(values) * 3 // 2), values.dtype)
        wider[:len(values)] = values
        return wider

    def add(self, ids, ends) -> range:
        """Numbers of new units, whose ids stand end to end and end at ``ends``."""
        at, n = int(self.begins[self.n]), self.n + len(ends)
        self.ids, self.begins = self._with_room(self.ids, at + len(ids)), self._with_room(self.begins, n + 1)
        self.uses = self._with_room(self.uses, n)
        self.ids[at:at + len(ids)] = ids
        self.begins[self.n + 1:n + 1] = at + np.asarray(ends, np.int64)
        numbers, self.n = range(self.n, n), n
        return numbers

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return np.diff(self.begins[:self.n + 1])[numbers]

    def joined(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of units, end to end."""
        begins = self.begins[:self.n + 1] * self.ids.itemsize
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), self.n, [None, pa.py_buffer(begins), pa.py_buffer(self.ids)])
        _, _, data = units.take(pa.array(numbers)).buffers()
        return np.frombuffer(data or b"", self.ids.dtype, int(sizes.sum()))


def encoder(tokenizer_file: str, end_id: int, room: int = 600_000) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Function from texts to their ids, each followed by ``end_id``, as one
    uint32 array and the documents' lengths.  Strings of special tokens in a
    text are ordinary text.

    A byte-level tokenizer always cuts before a space that no white space
    follows, and merges nothing across its cuts.  Its texts are cut there, and
    the library encodes each different unit once (until more than ``room``
    are remembered, see :class:`Numbered`); other tokenizers encode texts whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"        # the tasks are the parallelism
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = True
    separable = is_separable(tokenizer)
    sizes = np.zeros(max(tokenizer.get_vocab().values()) + 1, np.int64)
    for token, i in tokenizer.get_vocab().items():
        sizes[i] = len(token)                             # a character stands for a byte
    known = Numbered(end_id, room if separable else 0)

    def cut(text: str) -> tuple[list[str], str | None]:
        """Units to encode as they are, and the words after single spaces behind them, if any."""
        if not separable:
            return [text], None
        if SPACE_RUN.search(text) or text.endswith(" "):
            return SEPARABLE.split(text), None
        first, _, rest = text.partition(" ")
        return [first], rest or None

    def numbers_after(words: list[str]) -> np.ndarray:
        found = list(map(known.after.get, words))
        if new := [w for w, at in zip(words, found) if at is None]:
            for begin in range(0, len(new), AT_ONCE):
                some = new[begin:begin + AT_ONCE]
                known.after.update(zip(some, known.add(*encode_words(tokenizer, sizes, some))))
            found = list(map(known.after.__getitem__, words))
        return np.array(found, np.int32)

    def numbers_alone(units: list[str]) -> np.ndarray:
        if new := list(dict.fromkeys(u for u in units if u not in known.alone)):
            ids = [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            ends = np.cumsum([len(i) for i in ids])
            known.alone.update(zip(new, known.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1])), ends)))
        return np.fromiter(map(known.alone.__getitem__, units), np.int32, len(units))

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if known.full():
            known.forget_rare()
        plans = [cut(t) for t in texts]
        units = [u for some, _ in plans for u in some]
        n_alone = np.array([len(some) for some, _ in plans], np.int64)
        lists = pc.split_pattern(pa.array([rest for _, rest in plans], pa.large_string()), " ")
        del plans                                         # copies of the texts, as lists
        n_after = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()       # nulls hold no word
        del lists
        after = numbers_after(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        alone = numbers_alone(units)
        known.use(after)
        known.use(alone)
        # a document: its units, its words, its end
        kinds = np.tile(np.array([1, 2, 0], np.int8), len(texts)).repeat(
            np.column_stack((n_alone, n_after, np.ones_like(n_after))).ravel())
        numbers = np.zeros(len(kinds), np.int32)
        numbers[kinds == 1], numbers[kinds == 2] = alone, after[words.indices.to_numpy()]
        lengths = known.sizes(numbers)
        begins = np.concatenate(([0], np.flatnonzero(kinds == 0)[:-1] + 1))
        return known.joined(numbers, lengths), np.add.reduceat(lengths, begins)
    return encode


def in_chunks(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` text bytes each."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def sorted_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text) by ascending id, null first; equal ids by text hash."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return slim.repartitionByRange(*order).sortWithinPartitions(*order)


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int = 0,
                      doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the token files of ``docs`` to the folder ``path``.

    Columns: part (number of the file), offset (ids before the document in its
    file), doc_id, n_tokens (with the end id), tokens.  Files ascend by part,
    documents by id inside and across files.  Null and empty texts hold the
    end id alone; null ids come first; repeated rows repeat; other columns
    are left out.
    """
    spark = docs.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(tokenizer_file)
    name = tokenizer_file.rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()           # remembered units hold no cycles
        encode_texts = worker_encoder(SparkFiles.get(name), end_id)
        part, offset = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in in_chunks(whole, "text", SLICE):
                ids, sizes = encode_texts(batch.column("text").to_pylist())
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part, np.int32)), pa.array(offset + ends - sizes),
                     batch.column("doc_id"), pa.array(sizes), lists],
                    ["part", "offset", "doc_id", "n_tokens", "tokens"])
                offset += int(ends[-1])
                pa.default_memory_pool().release_unused()        # beside the remembered units

    (sorted_texts(docs, doc_id, text)
     .mapInArrow(encode, "part int, offset long, doc_id long, n_tokens long, tokens array<int>")
     .write.options(**PARQUET).parquet(path))


def document_starts(files: DataFrame) -> DataFrame:
    """(part, before): ids in all files before each file; reads two columns.
    One row per file."""
    totals = files.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document in the whole corpus), n_tokens, tokens."""
    files = spark.read.parquet(path)
    return files.join(document_starts(files), "part").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "tokens")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), as the files hold them."""
    ship_package(spark)
    files = spark.read.parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            at = lists.offsets.to_numpy().astype(np.int64)
            crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("offset"), batch.column("doc_id"),
                 pa.array(np.diff(at)), pa.array(crcs, pa.int64())],
                ["part", "offset", "doc_id", "n_tokens", "ids_crc32"])

    found = files.select("part", "offset", "doc_id", "tokens").mapInArrow(
        digest, "part int, offset long, doc_id long, n_tokens long, ids_crc32 long")
    return found.join(document_starts(files), "part").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def scratch_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
