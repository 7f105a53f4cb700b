"""SentencePiece BPE encoding with seeded merge-dropout, and decoding (operator 2).

Segmentation follows the library's agenda: candidate merges of adjacent
symbols are taken best score first, leftmost among equals.  With dropout, the
j-th candidate taken in a unit (a run that no merge can cross the ends of) is
skipped if a hash keyed by (seed, document, unit number, j) says so.  Without
dropout the pieces are the library's own; with it they vary, and always decode
to the same text.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from ..session import ship_package
from .names import free_prefix
from .token_files import in_chunks

SPACE = "\u2581"                       # the model's mark for a space
GOLDEN, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
DRAWS = 32                             # decisions drawn for a unit in one go
RESTS = [(1 << n) - 1 for n in range(DRAWS + 2)]         # the first n decisions
NEVER = np.int32(2 ** 31 - 1)


def _mix(z):
    """SplitMix64's finaliser of a Python integer; _mix_array: of a uint64 array."""
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return z ^ (z >> 31)


def _mix_array(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Segmenter:
    """Agenda segmentation over the pieces and scores of one model file.

    ``room`` bounds the units whose segmentations are remembered; their ids are
    held as bytes, a tenth of the room that lists of integers take.
    """

    def __init__(self, model_file: str, dropout: float = 0.1, room: int = 100_000):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        found = [(sp.get_score(i), sp.id_to_piece(i), i) for i in range(sp.get_piece_size())
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = np.array([s for s, _, _ in found])
        ranks = np.searchsorted(np.unique(-scores), -scores)         # equal scores rank equal
        self.pieces = {p: (int(r), i) for (_, p, i), r in zip(found, ranks)}
        self.threshold = round(dropout * 65536)
        self.mark = np.array([self.byte_ids[b] for b in SPACE.encode()], np.int32).tobytes()
        self.room, self.known = room, {"": (0, self.mark)}
        self._pairs(sp.get_piece_size())
        self._boundaries()

    def _pairs(self, size: int) -> None:
        """Hash table from (left id, right id) to the merged piece."""
        self.size, keys, values = size, [], []
        for p, (rank, i) in self.pieces.items():
            for cut in range(1, len(p)):
                a, b = self.pieces.get(p[:cut]), self.pieces.get(p[cut:])
                if a and b:
                    keys.append(a[1] * size + b[1])
                    values.append((rank, i))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.slot_rank, self.slot_id = np.full(1 << bits, NEVER, np.int32), np.zeros(1 << bits, np.int32)
        self.probes = 1
        for k, (rank, i) in zip(keys, values):
            at = ((k * GOLDEN) & MASK) >> int(self.shift)
            n = 1
            while self.slots[at] >= 0:
                at, n = (at + 1) & ((1 << bits) - 1), n + 1
            self.slots[at], self.slot_rank[at], self.slot_id[at] = k, rank, i
            self.probes = max(self.probes, n)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of merging; rank NEVER where the pair is no piece."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        at = ((key.astype(np.uint64) * np.uint64(GOLDEN)) >> self.shift).astype(np.int64)
        hit = self.slots[at]
        for _ in range(self.probes - 1):
            on = np.flatnonzero((hit != key) & (hit >= 0))
            if not len(on):
                break
            at[on] = (at[on] + 1) & (len(self.slots) - 1)
            hit[on] = self.slots[at[on]]
        good = hit == key
        return np.where(good, self.slot_rank[at], NEVER), np.where(good, self.slot_id[at], -1)

    def _boundaries(self) -> None:
        """Which neighbouring characters stand side by side in some piece; a
        text can be cut, without changing any merge, between all others."""
        inner = {c for p in self.pieces if len(p) > 1 for c in p}
        number = {c: i + 1 for i, c in enumerate(sorted(inner))}
        top = max(map(ord, number), default=0) + 2
        self.letter = np.zeros(top, np.int32)
        for c, i in number.items():
            self.letter[ord(c)] = i
        self.beside = np.zeros((len(number) + 1,) * 2, bool)
        for p in self.pieces:
            for a, b in zip(p, p[1:]):
                self.beside[number[a], number[b]] = True
        chars = {c: i for c, (_, i) in self.pieces.items() if len(c) == 1}
        self.char_id = np.full(max(map(ord, chars), default=0) + 2, -1, np.int32)
        for c, i in chars.items():
            self.char_id[ord(c)] = i

    def units(self, body: str) -> list[str]:
        points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[np.minimum(points, len(self.letter) - 1)]
        cuts = (np.flatnonzero(~self.beside[letters[:-1], letters[1:]]) + 1).tolist()
        return [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])]

    def _plain(self, symbols: list[int], unit: str) -> list[int]:
        """Byte pieces for the characters that are no piece."""
        if -1 not in symbols:
            return symbols
        unknown = iter([c for c in unit if c not in self.pieces])
        return [i for s in symbols for i in ([s] if s >= 0 else [self.byte_ids[b] for b in next(unknown).encode("utf-8", "surrogatepass")])]

    def agenda(self, unit: str, key: int, threshold: int) -> tuple[list[int], int]:
        """Ids of one unit and how many decisions were used, by a heap."""
        get = self.pieces.get
        symbols = list(unit)
        n, used = len(symbols), 0
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(hit[0], i, i + 1, len(pair)) for i in range(n - 1)
                  if (hit := get(pair := symbols[i] + symbols[i + 1]))]
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue                                  # a symbol has merged otherwise meanwhile
            word = _mix((key + (used >> 2) * GOLDEN) & MASK)
            skip = ((word >> (16 * (used & 3))) & 0xFFFF) < threshold
            used += 1
            if skip:
                continue
            symbols[left], symbols[right] = a + b, ""
            after = following[left] = following[right]
            a = symbols[left]
            if after < n:
                previous[after] = left
                if hit := get(a + symbols[after]):
                    heappush(agenda, (hit[0], left, after, size + len(symbols[after])))
            before = previous[left]
            if before >= 0 and (hit := get(symbols[before] + a)):
                heappush(agenda, (hit[0], before, left, size + len(symbols[before])))
        return self._plain([get(s, (0, -1))[1] for s in symbols if s], unit), used

    def agendas(self, units: list[str], keys: np.ndarray, threshold: int) -> tuple[list[bytes], np.ndarray]:
        """The same for many units of similar length at once: in each step every
        unit takes the best candidate of its agenda, and skips or merges it.
        Ids come as the bytes of 32-bit integers."""
        m = len(units)
        sizes = np.fromiter(map(len, units), np.int64, m)
        width = int(sizes.max()) + 1
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width)[None, :] < sizes[:, None]
        symbols = np.full((m, width), -2, np.int32)               # -2: no symbol here
        symbols[inside] = self.char_id[np.minimum(points, len(self.char_id) - 1)]
        rank = np.full((m, width), NEVER, np.int32)
        into = np.full((m, width), -1, np.int32)
        r, i = self._merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        rank[:, :-1], into[:, :-1] = r.reshape(m, -1), i.reshape(m, -1)
        following = np.minimum(np.tile(np.arange(1, width + 1, dtype=np.int32), (m, 1)), width - 1)
        previous = np.tile(np.arange(-1, width - 1, dtype=np.int32), (m, 1))
        row_numbers = np.arange(m)
        used, row, step, draws = np.zeros(m, np.int64), row_numbers, 0, None
        while True:
            best = rank[row].argmin(axis=1)
            on = rank[row, best] != NEVER
            row, best = row[on], best[on]
            if not len(row):
                break
            if step % 4 == 0:
                draws = _mix_array(keys + np.uint64(((step // 4) * GOLDEN) & MASK))
            skip = ((draws[row] >> np.uint64(16 * (step % 4))) & np.uint64(0xFFFF)) < threshold
            used[row] += 1
            step += 1
            rank[row[skip], best[skip]] = NEVER
            r, left = row[~skip], best[~skip]
            right = following[r, left]
            after, before = following[r, right], previous[r, left]
            symbols[r, left] = into[r, left]
            symbols[r, right] = -2
            rank[r, right] = NEVER
            following[r, left], previous[r, after] = after, left
            rank[r, left], into[r, left] = self._merged(symbols[r, left], symbols[r, after])
            has = before >= 0
            r, left, before = r[has], left[has], before[has]
            rank[r, before], into[r, before] = self._merged(symbols[r, before], symbols[r, left])
        keep = (symbols != -2) & inside
        counts = keep.sum(axis=1)
        ends = (4 * np.cumsum(counts)).tolist()
        flat = symbols[keep]
        data = flat.tobytes()
        out = [data[a:b] for a, b in zip([0, *ends], ends)]
        for n in np.unique(np.repeat(row_numbers, counts)[flat == -1]).tolist():
            out[n] = np.array(self._plain(np.frombuffer(out[n], np.int32).tolist(), units[n]), np.int32).tobytes()
        return out, used

    def _solve(self, units: list[str], keys: np.ndarray, threshold: int) -> tuple[list[bytes], np.ndarray]:
        """Agendas of any units, as bytes: by lengths, long ones by the heap."""
        out: list = [None] * len(units)
        used = np.zeros(len(units), np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        low = 0
        for high in (3, 5, 7, 9, 12, 16, 24, 40):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(some), 16384):
                part = some[at:at + 16384]
                found, n = self.agendas([units[i] for i in part.tolist()], keys[part], threshold)
                used[part] = n
                for i, ids in zip(part.tolist(), found):
                    out[i] = ids
        for i in np.flatnonzero(sizes > low).tolist():
            ids, used[i] = self.agenda(units[i], int(keys[i]), threshold)
            out[i] = np.array(ids, np.int32).tobytes()
        return out, used

    def encode_batch(self, texts: list[str | None], keys: list[int]) -> list[list[int]]:
        """Ids of each text, with a key each.  Null and empty: no ids.
        Literal space marks become byte pieces, so that they are not decoded
        as spaces."""
        units: list[str] = []
        own, ends = [], []
        for text, key in zip(texts, keys):
            begin = len(units)
            for p, part in enumerate(text.split(SPACE) if text else ()):
                if p:
                    units.append("")                       # stands for the literal mark
                if body := (part if p else SPACE + part).replace(" ", SPACE):
                    units += self.units(body)
            ends.append(len(units))
            own.append(_mix_array(np.uint64(key & MASK) + np.arange(len(units) - begin, dtype=np.uint64) * np.uint64(GOLDEN)))
        own = np.concatenate(own) if own else np.empty(0, np.uint64)
        # each unit's segmentation without a skip, and the decisions it rests on
        known = self.known
        if new := list(set(units).difference(known)):
            found, used = self._solve(new, np.zeros(len(new), np.uint64), 0)
            known.update(zip(new, zip(map(RESTS.__getitem__, np.minimum(used, DRAWS + 1).tolist()), found)))
        entries = [known[u] for u in units]
        got = [e[1] for e in entries]
        rests = np.fromiter((e[0] for e in entries), np.int64, len(entries))
        # the others, in which some decision is a skip, are segmented one by one
        skips = np.concatenate([self._skip_bits(own[at:at + 65536]) for at in range(0, len(own), 65536)] or [rests])
        other = np.flatnonzero(rests & skips) if self.threshold else ()
        if len(other):
            found, _ = self._solve([units[i] for i in other.tolist()], own[other], self.threshold)
            for i, ids in zip(other.tolist(), found):
                got[i] = ids
        if len(known) > self.room:
            known.clear()
            known[""] = (0, self.mark)
        return [np.frombuffer(b"".join(got[a:b]), np.int32).tolist() for a, b in zip([0, *ends], ends)]

    def _skip_bits(self, own: np.ndarray) -> np.ndarray:
        """Bit j: decision j is a skip; bit DRAWS, always set: more may be."""
        steps = np.arange(DRAWS // 4, dtype=np.uint64) * np.uint64(GOLDEN)
        draws = _mix_array(own[:, None] + steps[None, :]).astype("<u8").view("<u2").reshape(len(own), DRAWS)
        bits = np.packbits(draws < self.threshold, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)
        return bits | (1 << DRAWS)

    def encode(self, text: str | None, key: int) -> list[int]:
        return self.encode_batch([text], [key])[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def document_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Key of the merge decisions: of the id, or of the text where it is null."""
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("")))


_SEGMENTERS: dict[tuple[str, float], Segmenter] = {}          # of this worker process, which serves many tasks


def _segmenter(model_file: str, dropout: float) -> Segmenter:
    if (model_file, dropout) not in _SEGMENTERS:
        _SEGMENTERS[model_file, dropout] = Segmenter(model_file, dropout)
    return _SEGMENTERS[model_file, dropout]


def encode_documents(docs: DataFrame, model_file: str, *, dropout: float = 0.1, seed: int = 1,
                     doc_id: str = "doc_id", text: str = "text", ids_col: str = "piece_ids",
                     lossless_col: str = "lossless") -> DataFrame:
    """``docs`` with ``piece_ids`` array<int> and ``lossless`` boolean (the
    ids, decoded, are the text).

    Whole texts are encoded.  Null and empty texts have no ids; a null text
    counts as empty.  Rows that repeat an id and text repeat its
    segmentation; another ``seed`` gives another one.  Texts of any length are
    encoded; an empty table gives no rows.  Existing columns of these names are
    replaced, all others kept.
    """
    spark = docs.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]

    rows = docs.drop(ids_col, lossless_col)
    kept = rows.columns
    mark = free_prefix(rows, "_merge_")
    whole_text, key = mark + "text", mark + "key"
    rows = rows.withColumns({whole_text: F.coalesce(F.col(text), F.lit("")),
                             key: document_key(F.col(doc_id), F.col(text), seed)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()           # the many remembered units hold no cycles; walking them takes a fifth of the time
        segmenter = _segmenter(SparkFiles.get(name), dropout)
        for whole in batches:
            for batch in in_chunks(whole, whole_text, 1 << 19):
                texts = batch.column(whole_text).to_pylist()
                ids = segmenter.encode_batch(texts, batch.column(key).to_pylist())
                lossless = [a == b for a, b in zip(segmenter.library.decode(ids), texts)]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), lists, pa.array(lossless)],
                                                 [*kept, ids_col, lossless_col])

    schema = StructType([*rows.schema.fields[:len(kept)], StructField(ids_col, ArrayType(IntegerType())),
                         StructField(lossless_col, BooleanType())])
    return rows.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model_file: str, *, ids_col: str = "piece_ids",
                     text_col: str = "text") -> DataFrame:
    """``encoded`` with ``text`` decoded from ``piece_ids`` (null: empty)."""
    spark = encoded.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
        for ids in batches:
            yield pd.Series([library.decode([] if x is None else x.tolist()) for x in ids], dtype=object)

    return encoded.withColumn(text_col, decoded(F.col(ids_col)))
