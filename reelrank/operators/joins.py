"""Joins whose keys are few or are not equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
WORDS = 1 << 16     # of 64 bits, in which ``may_hold`` marks keys


def join_per_person(rows: DataFrame, people: DataFrame, spread_by: list[str], how: str = "left",
                    key: str = "user_id", salts: int = 32) -> DataFrame:
    """``rows`` joined to ``people``, a table of one row a ``key``.

    A person may hold a third of the rows: rows are dealt by (key, hash of
    ``spread_by`` modulo ``salts``), for which each person's row stands
    ``salts`` times.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = people.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def may_hold(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is none of ``keys`` (one
    column), by a scan alone: a join that follows shuffles the rest.

    A key marks one bit of 512 KB, whatever their number, so with very many
    keys most rows pass; none that holds a key is lost."""
    def place(c):
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(64 * WORDS))
    at = place(F.col(keys.columns[0]))
    words = (keys.select(F.floor(at / 64).alias("id"), (at % 64).alias("_b"))
             .groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, CAST(_b AS INT))")).alias("_w")))
    every = keys.sparkSession.range(WORDS).join(words, "id", "left")
    marks = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("_w", F.lit(0).cast("bigint")).alias("_w")))).alias("_s")).select(
        F.transform("_s", lambda s: s["_w"]).alias("_marks"))      # one row
    mine = place(F.col(column))
    holds = F.getbit(F.get(F.col("_marks"), F.floor(mine / 64).cast("int")), (mine % 64).cast("int")) == 1
    return rows.join(F.broadcast(marks), holds, "left_semi")


def _grams(text: Column, size: int) -> Column:
    n = F.char_length(text) - (size - 1)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): every text of ``texts`` (distinct, one column) that
    contains a needle of ``needles`` (distinct, one column, none empty).

    An inverted index holds the texts under their pieces of one to three
    characters.  A needle meets the texts under one piece only, that of its
    three-character pieces (itself, if it is shorter) under which fewest texts
    stand, and each meeting is verified.
    """
    t, n = F.col("text"), F.col("needle")
    texts = texts.select(F.col(texts.columns[0]).alias("text")).where(t.isNotNull())
    needles = needles.select(F.col(needles.columns[0]).alias("needle")).where(F.char_length(n) > 0)
    index = texts.select("text", F.explode(F.concat(*(_grams(t, i) for i in range(1, GRAM + 1)))).alias("gram"))
    asked = needles.select("needle", F.explode(F.when(F.char_length(n) < GRAM, F.array(n)).otherwise(_grams(n, GRAM))).alias("gram"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = (asked.join(held.hint("merge"), "gram", "left").groupBy("needle")
              .agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("least"))
              .select("needle", F.col("least.gram").alias("gram")))
    return rarest.join(index.hint("merge"), "gram").where(F.contains(t, n)).select("needle", "text")
