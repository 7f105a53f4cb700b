"""Cross-tokenizer alignment by an associative fragment monoid (operator 13).

Two tokenizers cut the same bytes.  Offsets where a token of each ends cut a
text into groups; the two tokens that end there are linked.  A byte range of a
text yields a :class:`Fragment`: an open run up to its first common end, closed
groups, and an open run after its last common end.  Fragments of adjacent
ranges compose associatively, so ranges of one very long document are encoded
by different tasks and composed by a tree of grouped rounds.

Groups are written as text, ``a1,a2|b1;a3|b2,b3``: token ids of both sides;
:func:`parse_groups` turns them into arrays.
"""

from __future__ import annotations

import gc
import math
import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship_package
from .token_files import (PARQUET, SPACE_RUN, Remembered, byte_of_char, encode_words, in_chunks, is_separable,
                          scratch_folder)

# Before a space that follows no space and that no white space follows.  A
# byte-level tokenizer cuts there, and no piece of the other reaches across.
SAFE = re.compile(r"(?<=[^ ])(?= \S)")
SPACE_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Body(NamedTuple):
    """Closed groups: their text, token counts and links (a id * B's size + b id)."""
    groups: str
    n_a: int
    n_b: int
    n_groups: int
    links: tuple[int, ...]


class Fragment(NamedTuple):
    """What a byte range knows.  Without a common end in the range (``body``
    is None) all its tokens are in ``left``."""
    left_a: str = ""
    left_b: str = ""
    body: Body | None = None
    right_a: str = ""
    right_b: str = ""


NOTHING = Body("", 0, 0, 0, ())
EMPTY = Fragment()


def _ids(run: str, more: str) -> str:
    return f"{run},{more}" if run and more else run or more


def group(a: str, b: str, size_b: int) -> Body:
    """The closed group of two runs of ids."""
    return Body(f"{a}|{b}", a.count(",") + 1, b.count(",") + 1, 1,
                (int(a[a.rfind(",") + 1:]) * size_b + int(b[b.rfind(",") + 1:]),))


def joined(bodies: Iterable[Body]) -> Body:
    bodies = [b for b in bodies if b[3]]
    return Body(";".join([b[0] for b in bodies]), sum([b[1] for b in bodies]), sum([b[2] for b in bodies]),
                sum([b[3] for b in bodies]), tuple(chain.from_iterable([b[4] for b in bodies])))


def compose(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """The fragment of a range from those of its two halves; associative,
    with :data:`EMPTY` as its neutral element."""
    if x.body is None:
        return Fragment(_ids(x.left_a, y.left_a), _ids(x.left_b, y.left_b), y.body, y.right_a, y.right_b)
    if y.body is None:
        return Fragment(x.left_a, x.left_b, x.body, _ids(x.right_a, y.left_a), _ids(x.right_b, y.left_b))
    between = group(_ids(x.right_a, y.left_a), _ids(x.right_b, y.left_b), size_b)
    return Fragment(x.left_a, x.left_b, joined([x.body, between, y.body]), y.right_a, y.right_b)


def whole(fragment: Fragment, size_b: int) -> Body:
    """The groups of a whole document, whose start and end both sides share."""
    if fragment.body is None:
        return NOTHING
    return joined([group(fragment.left_a, fragment.left_b, size_b), fragment.body])


class Aligner:
    """Both tokenizers, and the aligned units they have met (at most twice ``room``)."""

    def __init__(self, a_file: str, b_file: str, room: int = 80_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"        # the tasks are the parallelism
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        back = byte_of_char()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE_PIECE.fullmatch(p))
                        else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(pieces)
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_file, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        self.separable = (is_separable(self.a) and normal.add_dummy_prefix and not normal.remove_extra_whitespaces
                          and not normal.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
                          and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces))
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # ids as text, inside and at the end of a group
        self.said = [np.array([f"{i}{mark}" for i in range(n)], object) for n, mark in (
            (len(self.a_bytes), ","), (len(self.a_bytes), "|"), (self.size_b, ","), (self.size_b, ";"))]
        self.known = Remembered(room if self.separable else 0)          # Body, or None, by the unit less its space

    def units(self, text: str) -> list[str]:
        """Units, each less the space that begins it, of a text less the space
        that begins it (or the safe cut where it begins)."""
        if not self.separable:
            return [text]
        if SPACE_RUN.search(text) or text[:1].isspace() or text.endswith(" "):
            return [u[1:] for u in SAFE.split(" " + text)]
        return text.split(" ")

    def tokens(self, units: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """A and B ids of each unit; None if the bytes of either are not the unit's."""
        left = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        right = self.b.encode(units, num_threads=1)
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for unit, a, b in zip(units, left, right):
            data = (" " + unit).encode()
            yield (a, b) if b"".join(map(a_of, a)) == data == b"".join(map(b_of, b)) else None

    def words(self, words: list[str], together: int = 64) -> list[Body]:
        """The groups of words without spaces or U+2581, each with the space
        before it.  Many are encoded as one text, which both tokenizers cut
        between them, and all are aligned at once by the bytes where tokens end."""
        if not words:
            return []
        ids_a, cuts_a = encode_words(self.a, self.a_sizes, words, together)
        found = self.b.encode([" ".join(words[i:i + together]) for i in range(0, len(words), together)], num_threads=1)
        ids_b = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        if ends_a[-1] != ends_b[-1]:
            raise ValueError("the piece model changes the text")
        last_a = np.flatnonzero(ends_b[np.searchsorted(ends_b, ends_a)] == ends_a)          # tokens that end a group
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        cuts = np.searchsorted(last_a, cuts_a - 1) + 1                                       # groups up to each word's end
        if not np.array_equal(last_a[cuts - 1], cuts_a - 1):
            raise ValueError("the piece model merges across its cuts")
        # a group's tokens stand side by side: those of A, those of B
        group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
        group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
        pieces = np.empty(len(ids_a) + len(ids_b), object)
        at_a = np.arange(len(ids_a)) + np.concatenate(([0], last_b + 1))[group_a]
        at_b = np.arange(len(ids_b)) + (last_a + 1)[group_b]
        said_a, said_b = self.said[0][ids_a], self.said[2][ids_b]
        said_a[last_a], said_b[last_b] = self.said[1][ids_a[last_a]], self.said[3][ids_b[last_b]]
        pieces[at_a], pieces[at_b] = said_a, said_b
        pieces, ends = pieces.tolist(), (at_b[last_b] + 1)[cuts - 1].tolist()
        links = (ids_a[last_a].astype(np.int64) * self.size_b + ids_b[last_b]).tolist()
        n_a = np.diff(cuts_a, prepend=0).tolist()
        n_b = np.diff(last_b[cuts - 1] + 1, prepend=0).tolist()
        cuts = cuts.tolist()
        make = tuple.__new__           # without the checks of Body()
        return [make(Body, ("".join(pieces[p:q])[:-1], a, b, d - c, tuple(links[c:d])))
                for p, q, a, b, c, d in zip([0, *ends], ends, n_a, n_b, [0, *cuts], cuts)]

    def learn(self, units: Iterable[str]) -> None:
        """Align the units not met yet."""
        new = self.known.missing(units)
        plain = [u for u in new if u and " " not in u and SPACE_MARK not in u and not u[0].isspace()] if self.separable else []
        self.known.update(zip(plain, self.words(plain)))
        other = list(set(new).difference(plain))
        for unit, ids in zip(other, self.tokens(other)):
            self.known[unit] = None if ids is None else self._aligned(*ids)

    def _aligned(self, a: list[int], b: list[int]) -> Body:
        """The groups of one unit's tokens."""
        ends = [list(accumulate(sizes[i] for i in ids)) for sizes, ids in ((self.a_sizes, a), (self.b_sizes, b))]
        i = j = 0
        bodies = []
        for end in sorted(set(ends[0]).intersection(ends[1])):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            bodies.append(group(",".join(map(str, a[i:p])), ",".join(map(str, b[j:q])), self.size_b))
            i, j = p, q
        return joined(bodies)

    def documents(self, texts: list[str | None]) -> list[Body]:
        """The groups of whole texts; none where they do not stand for the text."""
        units = [self.units(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(units))
        known, out = self.known.__getitem__, []
        for some in units:
            bodies = list(map(known, some))
            out.append(NOTHING if None in bodies else joined(bodies))
        return out

    def ends_inside(self, unit: str, low: int, high: int) -> Fragment | None:
        """The fragment of a unit's bytes in (low, high]."""
        ids, = self.tokens([unit])
        if ids is None:
            return None
        a_ends = list(accumulate(len(self.a_bytes[i]) for i in ids[0]))
        b_ends = list(accumulate(len(self.b_bytes[i]) for i in ids[1]))
        common = sorted(e for e in set(a_ends) & set(b_ends) if low < e <= high)

        def run(after: int, to: int) -> tuple[str, str]:
            return tuple(",".join(str(i) for i, e in zip(some, ends) if after < e <= to)
                         for some, ends in zip(ids, (a_ends, b_ends)))
        if not common:
            return Fragment(*run(low, high))
        closed = [group(*run(p, q), self.size_b) for p, q in zip(common, common[1:])]
        return Fragment(*run(low, common[0]), joined(closed), *run(common[-1], high))

    def fragment(self, piece: str, low: int, high: int) -> Fragment | None:
        """The fragment of the bytes (low, high] of a piece that begins and
        ends at safe cuts; None if its tokens do not stand for it."""
        units = self.units(piece[1:])
        self.learn(units)
        out, closed, at = EMPTY, [], 0
        for unit in units:
            end = at + 1 + len(unit.encode())
            if (body := self.known[unit]) is None:
                return None
            if at >= low and end <= high and out.body is not None:
                closed.append(body)          # the units before it end at a common end
            elif end > low and at < high:
                out = compose(self._with(out, closed), self.ends_inside(unit, low - at, high - at), self.size_b)
                closed = []
            at = end
        return self._with(out, closed)

    @staticmethod
    def _with(fragment: Fragment, closed: list[Body]) -> Fragment:
        return fragment._replace(body=joined([fragment.body, *closed])) if closed else fragment

    def most_links(self) -> int:
        """No more different links can exist: of two tokens that end together,
        the bytes of one end with those of the other."""
        a, b = {}, {}
        for table, some in ((a, self.a_bytes), (b, self.b_bytes)):
            for x in some:
                table[x] = table.get(x, 0) + 1
        return (sum(n * b.get(x[i:], 0) for x, n in a.items() for i in range(len(x)))
                + sum(n * a.get(x[i:], 0) for x, n in b.items() for i in range(1, len(x))))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}          # of this worker process, which serves many tasks


def _aligner(a_name: str, b_name: str) -> Aligner:
    if (a_name, b_name) not in _ALIGNERS:
        gc.disable()           # the many remembered units hold no cycles; walking them takes a fifth of the time
        _ALIGNERS[a_name, b_name] = Aligner(SparkFiles.get(a_name), SparkFiles.get(b_name))
    return _ALIGNERS[a_name, b_name]


def _forget_aligners() -> None:
    """Encoding is over: what this worker remembers would only take room."""
    if _ALIGNERS:
        _ALIGNERS.clear()
        gc.enable()
        gc.collect()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def byte_ranges(text: str, chunk_bytes: int, units: list[str]) -> Iterator[tuple[str, int, int]]:
    """(piece, low, high): a text's ranges of about ``chunk_bytes`` bytes, each
    with the bytes around it up to safe cuts.  Bounds fall anywhere, but not
    inside a unit longer than a range, which only one range encodes."""
    cuts = np.concatenate(([0], np.cumsum([1 + len(u.encode()) for u in units])))
    total = int(cuts[-1])
    bounds = [0]
    for at in range(chunk_bytes, total, chunk_bytes):
        i = int(np.searchsorted(cuts, at, "right"))
        if cuts[i] - cuts[i - 1] <= chunk_bytes:
            bounds.append(at)
    for low, high in zip(bounds, [*bounds[1:], total]):
        first, last = int(np.searchsorted(cuts, low, "right")) - 1, int(np.searchsorted(cuts, high, "left"))
        begin = int(cuts[first])
        yield " " + " ".join(units[first:last]), low - begin, high - begin


BODY = "groups string, n_a long, n_b long, n_groups long, links array<long>"
PARTS = ["ok", "left_a", "left_b", "closed", "groups", "n_a", "n_b", "n_groups", "links", "right_a", "right_b"]
FRAGMENT = f"key string, k long, ok boolean, left_a string, left_b string, closed boolean, {BODY}, right_a string, right_b string"


def _bodies(bodies: list[Body]) -> list[pa.Array]:
    at = np.cumsum([0, *(len(b.links) for b in bodies)])
    links = np.fromiter(chain.from_iterable([b.links for b in bodies]), np.int64, int(at[-1]))
    return [pa.array([b.groups for b in bodies], pa.string()),
            *(pa.array([b[i] for b in bodies], pa.int64()) for i in (1, 2, 3)),
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(links))]


def _fragments(keys: list[str], ks: list[int], found: list[Fragment | None]) -> pa.RecordBatch:
    some = [f or EMPTY for f in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(ks, pa.int64()), pa.array([f is not None for f in found]),
         pa.array([f.left_a for f in some]), pa.array([f.left_b for f in some]),
         pa.array([f.body is not None for f in some]), *_bodies([f.body or NOTHING for f in some]),
         pa.array([f.right_a for f in some]), pa.array([f.right_b for f in some])], ["key", "k", *PARTS])


def _from_row(r: dict) -> Fragment | None:
    if not r["ok"]:
        return None
    body = Body(r["groups"], r["n_a"], r["n_b"], r["n_groups"], tuple(r["links"])) if r["closed"] else None
    return Fragment(r["left_a"], r["left_b"], body, r["right_a"], r["right_b"])


def align_documents(docs: DataFrame, a_file: str, b_file: str, *, chunk_bytes: int = 1 << 16, fan: int = 16,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, groups, n_a, n_b, n_groups, links of every row of ``docs``.

    ``a_file`` is a byte-level tokenizer file, ``b_file`` a piece model; both
    encode a space and the text.  ``groups`` is the alignment as text (see the
    module), ``links`` a number for each group: id of the last A token times
    B's vocabulary size, plus id of the last B token.

    Texts of more than ``chunk_bytes`` bytes are cut into byte ranges that
    different tasks encode; ``fan`` fragments at a time are composed until one
    is left.  A run without a safe cut is one unit at any length.

    Edge cases: null and empty texts, and texts whose tokens do not stand for
    their bytes (those with U+2581), have no tokens: empty groups, zeros.
    Repeated rows and null ids keep a row each; an empty table gives no rows;
    other columns are left out.
    """
    spark = docs.sparkSession
    ship_package(spark)
    for path in (a_file, b_file):
        spark.sparkContext.addFile(path)
    a_name, b_name = (p.rsplit("/", 1)[-1] for p in (a_file, b_file))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.octet_length("text") > chunk_bytes, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_name, b_name)
        for large in batches:
            for batch in in_chunks(large, "text", 1 << 19):
                bodies = align.documents(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_bodies(bodies)],
                                                 ["doc_id", "groups", "n_a", "n_b", "n_groups", "links"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_name, b_name)
        for batch in batches:
            for key, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                parts = list(byte_ranges(t, chunk_bytes, align.units(t)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array([p for p, _, _ in parts]),
                     pa.array([a for _, a, _ in parts], pa.int64()), pa.array([b for _, _, b in parts], pa.int64())],
                    ["key", "k", "piece", "low", "high"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_name, b_name)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                yield _fragments([r["key"]], [r["k"]], [align.fragment(r["piece"], r["low"], r["high"])])

    size_b = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()

    def reduce_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                some = [_from_row(x) for x in r["some"]]
                one = None if None in some else reduce(lambda x, y: compose(x, y, size_b), some, EMPTY)
                yield _fragments([r["key"]], [r["k"]], [one])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = _from_row(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"]]), *_bodies([NOTHING if f is None else whole(f, size_b)])],
                    ["key", "groups", "n_a", "n_b", "n_groups", "links"])

    out = slim.where(~is_long).mapInArrow(short, f"doc_id {kind}, {BODY}")
    keyed = slim.where(is_long).withColumn("key", F.sha2("text", 256))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal texts are aligned once; a document's ranges go to different tasks
    pieces = (keyed.select("key", "text").mapInArrow(cut, "key string, k long, piece string, low long, high long")
              .repartition(tasks, "key", "k").dropDuplicates(["key", "k"]))
    fragments = checkpoint(pieces.mapInArrow(encode, FRAGMENT))
    last = fragments.agg(F.max("k")).first()[0]
    if last is None:
        return out
    for _ in range(math.ceil(math.log(last + 1, fan) - 1e-9)):
        fragments = (fragments.groupBy("key", F.floor(F.col("k") / fan).cast("long").alias("parent"))
                     .agg(F.array_sort(F.collect_list(F.struct("k", *PARTS))).alias("some"))
                     .select("key", F.col("parent").alias("k"), "some").mapInArrow(reduce_some, FRAGMENT))
    found = fragments.mapInArrow(finish, f"key string, {BODY}")
    return out.unionByName(keyed.select("doc_id", "key").join(found, "key").drop("key"))


def parse_groups(groups: Column) -> Column:
    """``groups`` as array of struct (a: array of A ids, b: array of B ids)."""
    return F.when(groups == "", F.array().cast("array<struct<a:array<int>,b:array<int>>>")).otherwise(
        F.transform(F.split(groups, ";"), lambda g: F.struct(
            F.split(F.substring_index(g, "|", 1), ",").cast("array<int>").alias("a"),
            F.split(F.substring_index(g, "|", -1), ",").cast("array<int>").alias("b"))))


def link_counts(aligned: DataFrame, a_file: str, b_file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of the corpus, ascending; how often each occurs; and whether
    none with its B id occurs more often.

    The number of different links is bounded by the two vocabularies
    (:meth:`Aligner.most_links`), whatever the corpus.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_aligners()
        links, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in _slices(batches):
            new, n = np.unique(batch.column("links").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            links, at = np.unique(np.concatenate((links, new)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(links)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(counts)], ["link", "n"])

    tables = Aligner(a_file, b_file, room=0)
    found = (aligned.select("links").mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
             .limit(tables.most_links() + 1).toArrow().sort_by("link"))
    if found.num_rows > tables.most_links():
        raise ValueError("links of other tokenizers than these")
    links, counts = found["link"].to_numpy(), found["n"].to_numpy()
    highest = np.zeros(tables.size_b, np.int64)
    np.maximum.at(highest, links % tables.size_b, counts)
    return links, counts, counts == highest[links % tables.size_b]


def with_link_statistics(aligned: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """``aligned`` with n_links, n_best (links whose count is the highest of
    their B id, ties included) and count_sum in place of ``links``."""
    spark = aligned.sparkSession
    shared = spark.sparkContext.broadcast(link_counts(aligned, a_file, b_file))
    rest = [f for f in aligned.schema.fields if f.name != "links"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_aligners()
        links, counts, best = shared.value
        for batch in _slices(batches):
            lists = batch.column("links")
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.searchsorted(links, lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            sums = [np.concatenate(([0], np.cumsum(x[at])))[ends] - np.concatenate(([0], np.cumsum(x[at])))[ends - sizes]
                    for x in (best.astype(np.int64), counts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(sizes.astype(np.int64)), *map(pa.array, sums)],
                [*(f.name for f in rest), "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return aligned.mapInArrow(add, f"{kinds}, n_links long, n_best long, count_sum long")


def alignment_report(docs: DataFrame, a_file: str, b_file: str, **kw) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum.

    Every text is encoded once: digests and links are written to the shared
    folder, counted over the corpus, and read back.
    """
    spark = docs.sparkSession
    path = scratch_folder(spark, "alignment")
    aligned = align_documents(docs, a_file, b_file, **kw)
    (aligned.select("doc_id", "n_a", "n_b", "n_groups",
                    F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"), "links")
     .write.options(**PARQUET | {"parquet.dictionary.page.size": str(8 << 20)}).parquet(path))
    return with_link_statistics(spark.read.parquet(path), a_file, b_file)
