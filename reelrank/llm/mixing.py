"""Mix sources to target weights (operator 1).

Every document gets a hash-random key.  Documents are range-sorted by (source,
key), distributed prefix sums of their sizes give each its place in its
source's word stream, and the stream is cut at the source's budget: full
passes over the source first, then the leading part of one more pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .names import free_prefix
from .ordering import in_order, running_sums

WORD = r"[^\x20\x09-\x0D]+"


def mix_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hash-random key of a document: its id, or its text where it has none."""
    what = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), what).cast("binary"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple, max_epochs: int) -> DataFrame:
    """Targets of ``sources`` (source, source_size): one row per source.

    Sources in code-point order, null last, take ``weights`` in turn.  A
    target is min(max_epochs x size, level x weight), at the one level where
    targets sum to the total size: the fixed point of capping sources and
    sharing their excess among the others by weight.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running_sums(in_order(sources, *by_name), by_name, {"rank": F.lit(1)})
    turn = F.array(*(F.lit(float(w)) for w in weights))
    ranked = checkpoint(ranked.select(
        "source", "source_size", F.col("rank").cast("long"),
        F.get(turn, (F.col("rank") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap")))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return ranked.withColumn("target", F.lit(0.0))
    ratio = F.col("cap") / F.col("weight")
    by_ratio = [ratio, F.col("rank")]
    filled = running_sums(in_order(ranked, *by_ratio), by_ratio,
                          {"caps": F.col("cap"), "weights": F.col("weight")})
    level = (F.lit(total).cast("double") - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    at = filled.where(level <= ratio).agg(F.min_by(level, F.struct(ratio.alias("r"), "rank"))).first()[0]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"),
                                               F.lit(at) * F.col("weight")))


def _placed(docs: DataFrame, *, weights: tuple = (5, 2, 1), max_epochs: int = 3, seed: int = 1,
            doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per distinct (doc_id, source, size, mix_key) of ``docs``, with
    its ``copies``, the source's full passes (``epochs``) and the words that the
    cut pass still has for it and what follows (``room``, below 0 past the cut)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       word_count(F.col(text)).alias("size"),
                       mix_key(F.col(doc_id), F.col(text), seed).alias("mix_key"))
    # equal rows are one weighted row, so that no key is hot in the sort
    slim = checkpoint(slim.groupBy("doc_id", "source", "size", "mix_key").agg(F.count("*").alias("copies")))
    sources = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = source_targets(sources, weights, max_epochs)
    joined = slim.join(targets.withColumnRenamed("source", "_source"),
                       F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight", "cap")
    order = [F.col("rank"), F.col("mix_key"), F.col("doc_id"), F.col("size")]
    placed = running_sums(in_order(joined, *order), order,
                          {"before": F.col("size") * F.col("copies")}, ["rank"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - F.col("epochs") * F.col("source_size")
    return placed.withColumn("epochs", epochs.cast("long")).withColumn("room", (left - F.col("before")).cast("long"))


def mix(docs: DataFrame, *, weights: tuple = (5, 2, 1), max_epochs: int = 3, seed: int = 1,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: what the mix takes of it.

    Columns: doc_id, source, size (words), source_size, target, epochs (full
    passes over the source), part (words of the last, cut pass), taken
    (epochs x size + part), mix_key.  The source's taken words are its target
    rounded to a whole word: the document in which the cut falls is taken in
    part, the earlier ones whole.  The same seed gives the same mix.

    Edge cases: null and empty texts have size 0 and are taken 0 times; null
    is a source of its own; a null id is replaced by the text in the key;
    repeated rows each get their own row; an empty table gives no rows; other
    columns are ignored.
    """
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("copy") * F.col("size")))
    return (_placed(docs, weights=weights, max_epochs=max_epochs, seed=seed, doc_id=doc_id, text=text, source=source)
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .withColumn("part", part.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "epochs", "part",
                    (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "mix_key", "copy"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as rows of ``docs``: a document stands once per pass that takes it.

    Documents stay whole here: the one in which a source's cut falls stands in
    the last pass if at least half its words lie before the cut.  Columns are
    those of ``docs``.  Rows are matched to their decisions by id, source, size
    and key; only where the cut falls among rows that share all four are these
    numbered, in the order of their hashes.
    """
    row, pre = free_prefix(docs, "_row_"), free_prefix(docs, "_mix_")
    doc_id, text, source = kw.get("doc_id", "doc_id"), kw.get("text", "text"), kw.get("source", "source")
    size, copies = F.col("size"), F.col("copies")
    # so many of a row's copies have at least half their words before the cut
    extra = F.when(size > 0, F.greatest(F.lit(0), F.least(copies, F.floor((2 * F.col("room") + size) / (2 * size))))).otherwise(0)
    group = ["doc_id", "source", "size", "mix_key"]
    plan = _placed(docs, **kw).withColumn("extra", extra.cast("long")).select(
        *(F.col(c).alias(pre + c) for c in [*group, "copies", "epochs", "extra"]))
    plan = checkpoint(plan.where(f"{pre}epochs + {pre}extra > 0"))
    rows = docs.withColumns({row + "doc_id": F.col(doc_id), row + "source": F.col(source), row + "size": word_count(F.col(text)),
                             row + "mix_key": mix_key(F.col(doc_id), F.col(text), kw.get("seed", 1))})
    same = [F.col(row + c).eqNullSafe(F.col(pre + c)) for c in ("doc_id", "source")]
    same += [F.col(row + c) == F.col(pre + c) for c in ("size", "mix_key")]
    parted = f"{pre}extra > 0 and {pre}extra < {pre}copies"
    whole = rows.join(plan.where(f"not ({parted})"), same).withColumn(
        pre + "passes", F.col(pre + "epochs") + F.when(F.col(pre + "extra") > 0, 1).otherwise(0))
    # one such group per source at most; so few are sent to the rows, more meet them by a shuffle
    parts = plan.where(parted)
    parts = F.broadcast(parts) if parts.count() <= 10_000 else parts
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    turn = Window.partitionBy(*(pre + c for c in group)).orderBy(F.md5(F.col(text).cast("binary")), F.xxhash64(*hashed))
    cut = rows.join(parts, same).withColumn(
        pre + "passes", F.col(pre + "epochs") + F.when(F.row_number().over(turn) <= F.col(pre + "extra"), 1).otherwise(0))
    return (whole.unionByName(cut).where(f"{pre}passes > 0")
            .withColumn(pre + "pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col(pre + "passes"))))
            .select(*docs.columns))
