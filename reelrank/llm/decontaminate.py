"""Benchmark decontamination by one Aho-Corasick automaton (operator 12).

Questions and answers are cut into windows of consecutive words, and all
windows make one automaton over word numbers.  A text is lower-cased and cut
into words byte by byte, so a word's place in the normalised text is its place
in the original; one scan finds every occurrence of every window.

The automaton holds at most ``max_windows`` windows, a bound that is checked
before anything is sent to the tasks.  A larger benchmark is dealt over several
automata, and the hits of a document's scans are merged.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint, ship_package
from .token_files import in_chunks

# A-Z to a-z; what is in no word (ASCII but digits and letters) to a space.
# Each byte stays one byte, so offsets are those of the original.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
               for b in range(256))
PLACES = re.compile(rb"[^ ]+")
RUNS = "array<struct<word:int,word_end:int,start:int,end:int>>"
HITS = pa.list_(pa.struct([(n, pa.int32()) for n in ("word", "word_end", "start", "end")]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows_of(text: bytes | None, window: int) -> set[bytes]:
    """Windows of ``window`` words, joined by spaces; a shorter text is one."""
    words = words_of(text)
    return {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} - {b""}


def benchmark_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item, window): the distinct windows of every item; a null id reads ''."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = [], []
            for item, t in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                new = windows_of(t, window)
                items += [item] * len(new)
                found += new
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    slim = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, "item string, window binary").distinct()


class Machine:
    """The automaton over word numbers; number 0 is any word outside it."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        places: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for item, window in rows:
            at = places.setdefault(window, len(self.items))
            if at == len(self.items):
                self.items.append([])
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.split(b" "))
                self.automaton.add_word(key, (at, len(key)))
            self.items[at].append(item)
        if self.items:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[dict], set[str]]:
        """Number of words, runs of hit words, and the items found."""
        words = words_of(text)
        if not words or not self.items:
            return len(words), [], set()
        number = self.numbers.get
        ends: dict[int, int] = {}          # the longest window that ends at a word
        found = set()
        for end, (at, length) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            found.add(at)
            if length > ends.get(end, 0):
                ends[end] = length
        if not found:
            return len(words), [], set()
        runs = merged((end - length + 1, end + 1) for end, length in ends.items())
        spans = [m.span() for m in PLACES.finditer(text.translate(NORMAL))]
        chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)      # code points up to and with a byte
        return len(words), [
            {"word": a, "word_end": b, "start": int(chars[spans[a][0]]) - 1, "end": int(chars[spans[b - 1][1] - 1])}
            for a, b in runs], set().union(*(self.items[i] for i in found))


def merged(spans) -> list[tuple[int, int]]:
    """Spans as few as cover the same places, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_MACHINES: dict[str, Machine] = {}          # of this worker process, which serves many tasks


def _machine(name: str, shared) -> Machine:
    if name not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[name] = Machine(shared.value)
    return _MACHINES[name]


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_windows: int = 100_000,
                   doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, hits of every row of ``docs``.

    A word is hit inside any occurrence of a window of ``window`` consecutive
    words of an item; an item of fewer words, but not none, is one window.
    ``items``: ids, as sorted strings, of the items with an occurring window.
    ``hits``: the maximal runs of hit words: word, word_end (word places) and
    start, end (code points of the original text), each end exclusive.

    Edge cases: null, empty and wordless texts have no words and no hits; such
    items never occur.  A null item id reads ''; rows that repeat an item id
    are one item.  Repeated documents and null ids keep a row each; an empty
    benchmark hits nothing; an empty table gives no rows; texts are read whole
    at any length; other columns are left out.
    """
    spark = docs.sparkSession
    ship_package(spark)
    windows = checkpoint(benchmark_windows(benchmark, window, item_id, item_text))
    shards = max(1, -(-windows.count() // max_windows))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if shards == 1:
        return _scan(slim, windows)
    # the windows outgrow one automaton: a scan for each, and their hits merged
    shard = F.pmod(F.xxhash64("item", "window"), F.lit(shards))
    slim = slim.withColumn("key", F.xxhash64("doc_id", "text"))
    scans = _scan(slim, windows.where(shard == 0), "key")
    for n in range(1, shards):
        scans = scans.unionByName(_scan(slim, windows.where(shard == n), "key"))
    together = scans.groupBy("doc_id", "key").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("hits")).alias("hits"), (F.count("*") / shards).cast("int").alias("copies"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                hits = row["hits"]
                words = merged((h["word"], h["word_end"]) for h in hits)
                starts = {h["word"]: h["start"] for h in hits}
                ends = {h["word_end"]: h["end"] for h in hits}
                row["hits"] = [{"word": a, "word_end": b, "start": starts[a], "end": ends[b]} for a, b in words]
                row["n_hit"] = sum(b - a for a, b in words)
            yield pa.RecordBatch.from_pylist(rows, batch.schema.append(pa.field("n_hit", pa.int64())))

    out = together.mapInArrow(merge, StructType(list(together.schema.fields)).add("n_hit", "long"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("doc_id", "n_words", "n_hit", "items", "hits"))


def _scan(slim: DataFrame, windows: DataFrame, *keep: str) -> DataFrame:
    """One automaton over ``windows``, whose number the caller has checked."""
    rows = windows.toArrow()
    shared = slim.sparkSession.sparkContext.broadcast(
        list(zip(rows["item"].to_pylist(), rows["window"].to_pylist())))
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, shared)
        for whole in batches:
            for batch in in_chunks(whole, "text"):
                found = [machine.scan(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(batch.column(k) for k in keep),
                     pa.array([n for n, _, _ in found], pa.int64()),
                     pa.array([sum(r["word_end"] - r["word"] for r in runs) for _, runs, _ in found], pa.int64()),
                     pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string())),
                     pa.array([runs for _, runs, _ in found], HITS)],
                    ["doc_id", *keep, "n_words", "n_hit", "items", "hits"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(scan, f"doc_id {kinds['doc_id']}, {''.join(f'{k} {kinds[k]}, ' for k in keep)}"
                                 f"n_words long, n_hit long, items array<string>, hits {RUNS}")
