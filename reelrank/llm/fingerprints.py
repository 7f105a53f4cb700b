"""Order MinHash fingerprints by Spark expressions only (operator 10).

The k-mers of a text (k words) are numbered by occurrence, so that repeats
count.  Each of ``size`` components takes the ``tuple_size`` smallest hashes
under its own order, puts their k-mers back in text order and hashes the
tuple: it agrees for two texts only if they share those k-mers in that order.

All components order by one hash, rotated by a different amount each, so that
one sort of the k-mers serves them all.  Sorts run over longs that pack a hash
and a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .ordering import in_order, running_sums

BREAKS = r"[\x20\x09-\x0D]+"
POSITION_BITS, HASH_BITS = 28, 35
POSITION = (1 << POSITION_BITS) - 1
HASH = (1 << HASH_BITS) - 1


def _pack(hashed: Column, position: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit(HASH)), POSITION_BITS).bitwiseOR(position.cast("long"))


def _at(array: str, i: Column) -> Column:
    return F.get(array, i)


def with_fingerprint(df: DataFrame, text: str, out: str, *, k: int = 3, tuple_size: int = 2,
                     size: int = 64) -> DataFrame:
    """``df`` with ``out``: array of ``size`` ints, the text's fingerprint.

    A text of fewer than k words is one k-mer of all its words; with fewer
    than ``tuple_size`` k-mers tuples are shorter.  Null and wordless texts
    share one fingerprint.
    """
    t = {n: f"_{out}_{n}" for n in ("words", "n", "kmers", "starts", "marked", "sorted", "first", "m")}
    words, n = F.col(t["words"]), F.col(t["n"])
    df = df.withColumn(t["words"], F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS, -1), lambda w: w != ""))
    df = df.withColumn(t["n"], F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.lit(1), F.size(words) - (k - 1))))
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # k-mers in hash order; a k-mer's occurrences stand together, by position
    df = df.withColumn(t["kmers"], F.sort_array(F.transform(every, lambda i: _pack(
        F.xxhash64(*(_at(t["words"], i + (j - 1)) for j in range(k))), i))))
    kmer = lambda i: F.shiftright(_at(t["kmers"], i), POSITION_BITS)
    df = df.withColumn(t["starts"], F.filter(every, lambda i: (i == 1) | (kmer(i - 1) != kmer(i - 2))))
    numbered = F.flatten(F.transform(t["starts"], lambda s, r: F.transform(
        F.slice(t["kmers"], s, F.coalesce(_at(t["starts"], r + 1), n + 1) - s),
        lambda x, occurrence: _pack(F.xxhash64(F.shiftright(x, POSITION_BITS), occurrence),
                                    x.bitwiseAND(F.lit(POSITION))))))
    # each component's origin is sorted in with position 0, before any k-mer of its hash
    origins = F.array(*(F.lit(((HASH + 1) * i // size) << POSITION_BITS) for i in range(size)))
    df = df.withColumn(t["marked"], F.sort_array(F.concat(origins, numbered)))
    at_origin = lambda x: x.bitwiseAND(F.lit(POSITION)) == 0
    df = df.withColumn(t["sorted"], F.filter(t["marked"], lambda x: ~at_origin(x)))
    # of the entries before the i-th origin, i are origins and the others k-mers
    df = df.withColumn(t["first"], F.transform(
        F.filter(F.sequence(F.lit(0), n + (size - 1)), lambda i: at_origin(_at(t["marked"], i))),
        lambda p, i: p - i))
    df = df.withColumn(t["m"], F.least(F.lit(tuple_size), n))

    def component(first: Column) -> Column:
        if tuple_size == 2:
            a, b = _at(t["sorted"], first % n), _at(t["sorted"], (first + 1) % n)
            pa, pb = a.bitwiseAND(F.lit(POSITION)), b.bitwiseAND(F.lit(POSITION))
            a, b = F.shiftright(a, POSITION_BITS), F.shiftright(b, POSITION_BITS)
            return F.when(F.col(t["m"]) < 2, F.xxhash64(a)).when(pa < pb, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        chosen = F.transform(F.sequence(F.lit(0), F.col(t["m"]) - 1), lambda j: _at(t["sorted"], (first + j) % n))
        by_place = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(x.bitwiseAND(F.lit(POSITION)), HASH_BITS)
                                            .bitwiseOR(F.shiftright(x, POSITION_BITS))))
        return F.xxhash64(F.transform(by_place, lambda x: x.bitwiseAND(F.lit(HASH))))

    low = lambda h: F.shiftright(h, 32).cast("int")
    signature = F.when(n > 0, F.transform(t["first"], lambda f: low(component(f)))).otherwise(
        F.array_repeat(F.lit(0), size))
    return df.withColumn(out, signature).drop(*t.values())


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def fingerprint_text(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def fingerprint_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """doc_id, n_chars, signature, fingerprint of every document.

    Each row of the table gets a row; null texts count as empty, ids may be
    null or repeat, other columns are ignored.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return with_fingerprint(slim, "_text", "signature", **kw).select(
        "doc_id", F.char_length("_text").cast("long").alias("n_chars"), "signature",
        fingerprint_text(F.col("signature")).alias("fingerprint"))


def edit_probe(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Likeness of each document to its edited text and to the next document.

    Documents stand in descending id, then by text hash; the edited text has
    its last third replaced by the beginning of the next document's text.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Edge cases: null texts are empty; null ids come last; rows that repeat id
    and text have one place together and each gets that place's result; a
    table of one document is its own next; an empty table gives no rows.
    """
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    whole = whole.withColumns({"_k": F.xxhash64("doc_id", "_text"), "_id": F.coalesce("doc_id", F.lit(-1))})
    marks = with_fingerprint(whole.withColumn("n_chars", F.char_length("_text")), "_text", "_fp", **kw).select(
        "doc_id", "_k", "_id", "n_chars", "_fp")
    marks = checkpoint(marks)
    places = marks.groupBy("doc_id", "_k", "_id").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("rows"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_k")]
    # a document's text is dealt by key once, for both joins below
    texts = whole.select("_k", "_id", "_text")
    placed = checkpoint(running_sums(in_order(places, *order), order, {"place": F.lit(1)})
                        .select("_k", "_id", "n_chars", "rows", "place"))
    count, repeated = placed.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    after = placed.select(F.col("_k").alias("to_k"), F.col("_id").alias("to_id"), F.col("n_chars").alias("to_chars"),
                          F.pmod(F.col("place") + 1, F.lit(max(count, 1))).alias("place"))
    # _k, _id: a document; to_k, to_id: the one that it follows
    follows = placed.select("_k", "_id", "place").join(after, "place").drop("place")
    giving = texts.join(follows, ["_k", "_id"])
    pieces = giving.select(F.col("to_k").alias("_k"), F.col("to_id").alias("_id"),
                           F.substr("_text", F.lit(1), F.floor(F.col("to_chars") / 3).cast("int")).alias("_piece"))
    next_marks = marks.join(follows, ["_k", "_id"]).select(
        F.col("to_k").alias("_k"), F.col("to_id").alias("_id"), F.col("_fp").alias("_next_fp"))
    own_marks = marks.select("doc_id", "_k", "_id", "n_chars", "_fp")
    if repeated > 1:        # rows that repeat an id and text give the same piece and marks
        pieces, next_marks, own_marks = (x.dropDuplicates(["_k", "_id"]) for x in (pieces, next_marks, own_marks))
    n = F.char_length("_text")
    edited = (texts.join(pieces, ["_k", "_id"])
              .withColumn("_edited", F.concat(F.substr("_text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("_piece")))
              .select("_k", "_id", "_edited"))
    edited = with_fingerprint(edited, "_edited", "_edited_fp", **kw).select(
        "_k", "_id", "_edited_fp", F.sha2("_edited", 256).alias("edited_sha256"))
    return (edited.join(own_marks, ["_k", "_id"]).join(next_marks, ["_k", "_id"])
            .select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
                    fingerprint_text(F.col("_fp")).alias("fingerprint"),
                    fingerprint_text(F.col("_edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"),
                    likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next")))
