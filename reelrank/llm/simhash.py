"""SimHash near-duplicates by deletion-variant signatures (operator 5).

The 64 bits are cut into so few segments that, of two fingerprints within the
maximum distance, one segment differs by at most one bit.  Each fingerprint is
indexed by that segment with one bit wildcarded (and by the segment unchanged),
together with one piece of the other bits that must then be equal; equal keys
are joined and verified by the real distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, ship_package
from .components import connected_components
from .names import free_prefix

BITS = 64


def simhash64(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit integer; no words: 0.

    A-Z are lower-cased, words are maximal runs outside 0x20 and 0x09-0x0D,
    shingles (with repeats) are joined by one space and hashed by XXH64 with
    seed 42.  A bit is 1 if it is set in over half the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist())
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    value = int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")
    return value - (1 << BITS) if value >> 63 else value


def fingerprint_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t, shingle) for t in texts], dtype="int64")
    return fingerprint(text)


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _cuts(begin: int, end: int, n: int) -> list[tuple[int, int]]:
    edges = [begin + (end - begin) * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variant_keys(fp: Column, max_bits: int) -> Column:
    """Array of (key, side): where ``fp`` stands in the index.

    Segment ``s`` is used for pairs whose earlier segments differ by two bits
    or more, so by 2s + e <= max_bits.  Side 2: the segment unchanged (e = 0).
    Side 0 or 1: one bit wildcarded (e = 1), the side is that bit's value, so
    only fingerprints that differ in it meet.  The bits outside the segment
    then differ by at most max_bits - e, so of max_bits - e + 1 pieces one is
    equal; it is part of the key.
    """
    n = max(2, max_bits // 2 + 1)
    out = []
    for s, (at, width) in enumerate(_cuts(0, BITS, n)):
        segment = _bits(fp, at, width)
        rest = F.shiftrightunsigned(fp, at + width) if at == 0 else (
            _bits(fp, 0, at).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, at + width), at))
            if at + width < BITS else _bits(fp, 0, at))
        for e in (0, 1):
            if 2 * s + e > max_bits:
                continue
            for p, (pat, pwidth) in enumerate(_cuts(0, BITS - width, max_bits - e + 1)):
                piece = _bits(rest, pat, pwidth)
                for j in range(width if e else 1):
                    kept = segment.bitwiseAND(F.lit(~(1 << j))) if e else segment
                    side = _bits(segment, j, 1).cast("int") if e else F.lit(2)
                    tag = ((s * 2 + e) * 64 + p) * 64 + j
                    out.append(F.struct(F.xxhash64(F.lit(tag), kept, piece).alias("key"), side.alias("side")))
    return F.array(*out)


def near_links(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Every pair (a, b) of distinct fingerprints ``fp`` within ``max_bits``.

    A fingerprint has at most a constant number of such neighbours, so the
    result is linear in the input.
    """
    # a few bytes a row become some seventy rows: deal them to all tasks first
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = fingerprints.repartition(parts, "fp").select("fp", F.inline(variant_keys(F.col("fp"), max_bits)))
    left = index.where("side in (0, 2)").select("key", "side", F.col("fp").alias("l"))
    right = index.where("side in (1, 2)").select("key", F.col("fp").alias("r"))
    near = F.bit_count(F.col("l").bitwiseXOR(F.col("r"))) <= max_bits
    met = left.join(right.hint("merge"), (left.key == right.key) & ((F.col("side") == 0) | (F.col("l") < F.col("r"))) & near)
    return met.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_bits: int = 2,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its class of near-duplicates.

    Columns: doc_id, text_hash (xxhash64 of the text), fp (the fingerprint as
    a signed long), fingerprint (16 hex digits), component_fp (smallest
    fingerprint of the component), component_id (smallest doc_id of it).

    Links join distinct fingerprints, so copies cost one index entry together.
    Edge cases: null, empty and blank texts have fingerprint zero and link
    like any other; a null doc_id is never the smallest (a component without
    any id has component_id null); repeated rows each get a row; an empty
    table gives none; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    slim = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                                  fingerprint_column(F.col(text), shingle).alias("fp")))
    distinct = checkpoint(slim.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(distinct, max_bits))
    classes = (distinct.join(roots.hint("merge"), distinct.fp == roots.node, "left")
               .select("fp", "first_id", F.coalesce("root", "fp").alias("component_fp")))
    ids = classes.groupBy("component_fp").agg(F.min("first_id").alias("component_id"))
    named = classes.join(ids.hint("merge"), "component_fp").select("fp", "component_fp", "component_id")
    return slim.join(named.hint("merge"), "fp").select(
        "doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_fp", "component_id")


def one_per_component(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each component: smallest doc_id, null last,
    then smallest text hash; of fully repeated rows, one."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **kw)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash"))
    mark = free_prefix(docs, "_near_")
    key, same_id, number = mark + "key", mark + "id", mark + "turn"
    keep = found.groupBy("component_fp").agg(first.alias("k")).select(
        F.xxhash64("k.doc_id", "k.text_hash").alias(key), F.coalesce("k.doc_id", F.lit(-1)).alias(same_id))
    rows = docs.withColumns({key: F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text))),
                             same_id: F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))})
    turn = Window.partitionBy(key, same_id).orderBy(F.lit(0))
    return (rows.join(keep.distinct().hint("merge"), [key, same_id])
            .withColumn(number, F.row_number().over(turn)).where(F.col(number) == 1)
            .select(*docs.columns))
