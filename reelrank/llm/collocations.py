"""Phrase collocation mining by stripes (operator 11).

A stripe belongs to a prefix of one to three words: an associative counter of
the words that come next, with the prefix's own total under no word.  Stripes
of one prefix merge elementwise, and one merged stripe gives the extensions of
its prefix (counts of longer phrases), its total, and the largest count among
its extensions, which decides whether they subsume it.

Only phrases of ``least`` or more occurrences matter, and all parts of such a
phrase are as frequent; so words are counted first, then pairs of frequent
words, then phrases of three and four words whose pairs are all frequent.
Tasks know the frequent words and pairs by a bitmap of bounded size: a phrase
that it lets through wrongly costs room, and its exact count drops it.

The stripe of a very frequent prefix is dealt in segments by the next word, in
proportion to the prefix's share of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .token_files import in_chunks, scratch_folder

BREAK = b"\xff"          # in no UTF-8 text
# A-Z to a-z, tab to space, what ends a piece to BREAK
NORMAL = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ROTATE = 21
STRIPE = "lang string, prefix string, seg int, nexts string, counts array<int>"


class Words(dict):
    """Numbers of the words of one language in a block; -1 for a break and for
    a word that cannot be frequent."""

    def __init__(self, lang: str, block: Block):
        super().__init__({BREAK: -1})
        self.lang, self.block = lang, block
        self.number = len(block.langs)
        block.langs.append(lang)
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)

    def __missing__(self, word: bytes) -> int:
        block, n = self.block, -1
        at = hashed = xxhash.xxh64_intdigest(word, self.seed) if block.frequent else 0
        if block.frequent:
            at &= 8 * len(block.frequent) - 1
        if not block.frequent or block.frequent[at >> 3] >> (at & 7) & 1:
            n = len(block.words)
            block.words.append(word)
            block.hashes.append(hashed)
            block.lang_of.append(self.number)
        self[word] = n
        return n


class Block:
    """Consecutive texts of a task as word numbers."""

    def __init__(self, frequent: bytes = b""):
        self.frequent = frequent
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.hashes: list[int] = []
        self.lang_of: list[int] = []
        self.by_lang: dict[str, Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        if lang not in self.by_lang:
            self.by_lang[lang] = Words(lang, self)
        said = BREAK.join([*texts, b""]).translate(NORMAL).replace(BREAK, b" \xff ").split()
        self.parts.append(np.fromiter(map(self.by_lang[lang].__getitem__, said), np.int32, len(said)))
        self.size += len(said)

    def numbers(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.array([-1], np.int32)])

    def word_array(self) -> pa.Array:
        return pa.array(self.words, pa.binary())

    def lang_array(self, words: np.ndarray) -> pa.Array:
        of = np.array(self.lang_of, np.int32)
        return pa.array(self.langs, pa.string()).take(pa.array(of[words]))


def blocks(batches: Iterator[pa.RecordBatch], most: int, frequent: bytes = b"") -> Iterator[Block]:
    """Blocks of about ``most`` words of a partition's (lang, text) rows."""
    block = Block(frequent)
    for whole in batches:
        for batch in in_chunks(whole, "text", 2 << 20):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                block.add(lang, some)
            if block.size >= most:
                yield block
                block = Block(frequent)
    if block.size:
        yield block


def stripes_of(block: Block, prefix_words: list[np.ndarray], prefix: np.ndarray, next_word: np.ndarray,
               counts: np.ndarray, totals: np.ndarray | None, segments: np.ndarray) -> pa.RecordBatch:
    """Stripes of a block: ``prefix_words`` are the words of each prefix,
    (prefix, next_word, counts) the extensions, ``totals`` each prefix's own.
    A stripe's words travel as one string, the prefix's own total first, under
    an empty word."""
    hashes = np.array(block.hashes, np.uint64)
    seg = (hashes[next_word] % segments[prefix].astype(np.uint64)).astype(np.int64)
    if totals is not None:
        own = np.flatnonzero(totals)
        prefix, next_word, counts, seg = (np.concatenate(x) for x in (
            (own, prefix), (np.full(len(own), -1), next_word), (totals[own], counts), (np.zeros(len(own), np.int64), seg)))
    order = np.lexsort((next_word, seg, prefix))
    prefix, next_word, counts, seg = prefix[order], next_word[order], counts[order], seg[order]
    first = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (seg[1:] != seg[:-1]))) if len(prefix) else np.empty(0, int)
    words, at = block.word_array(), prefix[first]
    text = words.take(pa.array(prefix_words[0][at]))
    for more in prefix_words[1:]:
        text = pc.binary_join_element_wise(text, words.take(pa.array(more[at])), pa.scalar(b" ", pa.binary()))
    ends = pa.array(np.append(first, len(prefix)), pa.int32())
    said = pa.concat_arrays([words, pa.array([b""], pa.binary())]).take(pa.array(np.where(next_word < 0, len(words), next_word)))
    nexts = pc.binary_join(pa.ListArray.from_arrays(ends, said), pa.scalar(b" ", pa.binary()))
    return pa.RecordBatch.from_arrays(
        [block.lang_array(prefix_words[0][at]), text.cast(pa.string()), pa.array(seg[first], pa.int32()),
         nexts.cast(pa.string()), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))],
        ["lang", "prefix", "seg", "nexts", "counts"])


def _segments(size: int, found: Iterator[tuple[int, int]]) -> np.ndarray:
    out = np.ones(size, np.int64)
    for at, n in found:
        out[at] = n
    return out


def pair_stripes(block: Block, heavy: dict[tuple[str, str], int]) -> pa.RecordBatch:
    """Stripes of single words over pairs of words."""
    s, v = block.numbers(), max(1, len(block.words))
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    codes, counts = np.unique(s[at].astype(np.int64) * v + s[at + 1], return_counts=True)
    known = ((block.by_lang[lang].get(w.encode(), -1), n) for (lang, w), n in heavy.items() if lang in block.by_lang)
    return stripes_of(block, [np.arange(v)], codes // v, codes % v, counts, np.bincount(s[s >= 0], minlength=v),
                      _segments(v, ((i, n) for i, n in known if i >= 0)))


def longer_stripes(block: Block, pairs: bytes, heavy: dict[tuple[str, str, str], int]) -> Iterator[pa.RecordBatch]:
    """Stripes of pairs, and of phrases of three words, whose pairs ``pairs`` holds."""
    s, v = block.numbers(), max(1, len(block.words))
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    codes, number = np.unique(s[at].astype(np.int64) * v + s[at + 1], return_inverse=True)
    hashes, bits = np.array(block.hashes, np.uint64), np.frombuffer(pairs, np.uint8)
    one, two = codes // v, codes % v
    turned = (hashes[two] << np.uint64(ROTATE)) | (hashes[two] >> np.uint64(64 - ROTATE))
    place = ((hashes[one] ^ turned) & np.uint64(8 * len(pairs) - 1)).astype(np.int64)
    kept = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
    renumber = np.full(len(codes) + 1, -1, np.int64)
    renumber[kept] = np.arange(len(kept))
    pair = np.full(len(s) + 1, -1, np.int64)          # pair that begins at each place
    pair[at] = renumber[number]
    one, two = one[kept], two[kept]
    codes = codes[kept]

    def heavy_pairs():
        for (lang, x, y), n in heavy.items():
            if lang in block.by_lang:
                i, j = (block.by_lang[lang].get(w.encode(), -1) for w in (x, y))
                where = int(np.searchsorted(codes, i * v + j))
                if i >= 0 and j >= 0 and where < len(codes) and codes[where] == i * v + j:
                    yield where, n
    segments = _segments(len(codes), heavy_pairs())
    at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    triples, number, counts = np.unique(pair[at] * v + s[at + 2], return_inverse=True, return_counts=True)
    yield stripes_of(block, [one, two], triples // v, triples % v, counts,
                     np.bincount(pair[pair >= 0], minlength=len(codes)), segments)
    triple = np.full(len(s) + 1, -1, np.int64)
    triple[at] = number
    at = np.flatnonzero((triple[:-1] >= 0) & (triple[1:] >= 0))
    fours, counts = np.unique(triple[at] * v + s[at + 3], return_counts=True)
    base = triples // v
    # the total of three words stands in the stripe of the first two
    yield stripes_of(block, [one[base], two[base], triples % v], fours // v, fours % v, counts, None, segments[base])


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, next, n): stripes merged elementwise, counts of ``least``
    or more; a null next is the prefix itself.  A stripe is shuffled whole,
    and its elements are summed where it arrives."""
    dealt = stripes.repartition("lang", "prefix", "seg")
    return (dealt.select("lang", "prefix", "seg", F.inline(F.arrays_zip(F.split("nexts", " "), "counts")).alias("next", "n"))
            .groupBy("lang", "prefix", "seg", "next").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least).select("lang", "prefix", F.nullif("next", F.lit("")).alias("next"), "n"))


def bitmap(hashes: DataFrame, max_bits: int) -> bytes:
    """Bits set at the hashes ``h``: 16 bits a row, a power of two, and at
    most ``max_bits`` whatever the rows."""
    bits = min(max_bits, max(1 << 16, 1 << (16 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    # shifts count modulo 64
    found = hashes.groupBy(F.shiftright(at, 6).alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("word")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[found["slot"].to_numpy()] = found["word"].to_numpy()
    return out.tobytes()


def _hash(lang: str, word: str) -> Column:
    return F.xxhash64(lang, word)


def _heavy(rows: DataFrame, n: Column, share: int, total: int, *key: str) -> dict:
    """Segments of the phrases with over 1/``share`` of all words; at most ``share`` of them."""
    fair = max(1, total // share)
    return {tuple(r[k] for k in key): -(-r["n"] // fair) for r in rows.where(n > fair).select(*key, n.alias("n")).collect()}


def phrase_counts(docs: DataFrame, path: str, *, least: int = 30, lang: str = "lang", text: str = "text",
                  block_words: int = 3_000_000, max_bits: int = 1 << 28, share: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words of each lang, merged stripes of one word, merged stripes of two and three words).

    Each is written under ``path``.  The first holds (lang, n): all word
    occurrences.  Broadcast are two bitmaps of ``max_bits`` bits at most, and
    at most ``share`` prefixes of each length that get segments.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_words):
            s = block.numbers()
            counts = np.bincount(s[s >= 0], minlength=len(block.words))
            of = np.array(block.lang_of, np.int64)
            totals = np.bincount(of, counts, len(block.langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*block.langs, *(block.langs[i] for i in block.lang_of)], pa.string()),
                 pa.concat_arrays([pa.nulls(len(block.langs), pa.string()), block.word_array().cast(pa.string())]),
                 pa.array(np.concatenate((totals, counts)))], ["lang", "word", "n"])

    (slim.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
     .where((F.col("n") >= least) | F.col("word").isNull()).write.parquet(f"{path}/words"))
    words = spark.read.parquet(f"{path}/words")
    sizes = words.where(F.col("word").isNull()).select("lang", "n")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    single = words.where(F.col("word").isNotNull())
    shared = spark.sparkContext.broadcast((bitmap(single.select(_hash("lang", "word").alias("h")), max_bits),
                                           _heavy(single, F.col("n"), share, total, "lang", "word")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, heavy = shared.value
        for block in blocks(batches, block_words, frequent):
            yield pair_stripes(block, heavy)

    merged(slim.mapInArrow(pairs, STRIPE), least).write.parquet(f"{path}/one")
    one = spark.read.parquet(f"{path}/one")
    two = one.where(F.col("next").isNotNull())
    turned = _hash("lang", "next")
    turned = F.shiftleft(turned, ROTATE).bitwiseOR(F.shiftrightunsigned(turned, 64 - ROTATE))
    also = spark.sparkContext.broadcast((bitmap(two.select(_hash("lang", "prefix").bitwiseXOR(turned).alias("h")), max_bits),
                                         _heavy(two, F.col("n"), share, total, "lang", "prefix", "next")))

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heavy = also.value
        for block in blocks(batches, block_words, shared.value[0]):
            yield from longer_stripes(block, held, heavy)

    merged(slim.mapInArrow(longer, STRIPE), least).write.parquet(f"{path}/more")
    return sizes, one, spark.read.parquet(f"{path}/more")


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, keep_below: int = 80, **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    A candidate is a phrase of 2 to 4 words with a = ``least`` occurrences or
    more inside pieces.  Each cut into a first part (l occurrences) and a rest
    (r) scores floor(2000000 a / (l + r)); the lowest counts, ties to the
    shorter first part.  A candidate goes if a longer one holds it that occurs
    ``keep_below`` percent as often or more.

    Edge cases: null texts are empty, a null lang reads ``und``; repeated rows
    count each time; texts of any length are read whole; a table without
    candidates, or empty, gives no rows; other columns are ignored.  Ties in
    score and count go by phrase, in UTF-8 byte order.
    """
    sizes, one, more = phrase_counts(docs, scratch_folder(docs.sparkSession, "collocations"), least=least, **kw)
    phrase = F.concat_ws(" ", "prefix", "next")
    stripes = (one.unionByName(more).where(F.col("next").isNotNull())
               .select("lang", "prefix", "next", phrase.alias("phrase"), F.col("n").alias("a"))
               .withColumn("words", F.size(F.split("phrase", " "))))
    totals = one.where(F.col("next").isNull()).select("lang", F.col("prefix").alias("part"), F.col("n").alias("f")).unionByName(
        stripes.where(F.col("words") < 4).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    parts = (stripes.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "words")
             .select("lang", "phrase", "a", "k", F.explode(F.expr(
                 "array(struct(true as is_first, substring_index(phrase, ' ', k) as part),"
                 " struct(false as is_first, substring_index(phrase, ' ', k - words) as part))")).alias("p"))
             .select("lang", "phrase", "a", "k", "p.is_first", "p.part"))
    cuts = (parts.join(totals, ["lang", "part"]).groupBy("lang", "phrase", "a", "k")
            .agg(F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r")))
    # decimals: the products may pass 64 bits
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # a phrase's extensions by one word: to the right they are its own stripe; any longer one holds one of them
    extended = (stripes.where(F.col("words") > 2)
                .select("lang", "a", F.explode(F.array("prefix", F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
                .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = best.join(extended, ["lang", "phrase"], "left").where(F.expr(
        f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {keep_below}"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
