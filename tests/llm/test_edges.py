"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelrank.llm import (ann, chat, fingerprints, licenses, merge_dropout, mixing, simhash, token_files,
                          token_scan, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word other thing. " * 20000
ROWS = [(1, "one two three four five", "en", "a", 5), (1, "one two three four five", "en", "a", 5),
        (2, None, None, "b", None), (3, "", "en", None, 0), (None, "no id here at all", "en", "a", 1),
        (None, None, "en", None, 1), (4, " \t\n", "en", "b", 3), (5, LONG, "en", "c", 1),
        (6, "one two three four five", "en", "c", 5), (-7, "ｆｕｌｌ ▁ mark\x00 \\ </s>", "de", "d", 9)]
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASH = ["size", "fp", "key", "side", "u", "place", "_part", "score", "offending", "piece_ids", "lossless", "words",
         "licenses", "turns", "part", "offset", "tokens", "node", "root", "taken", "target", "n", "h", "rep", "_text", "_lines",
         "_license_lines", "_by_flow", "_scored_", "_scored", "_tox_score", "_tox", "_merge_text", "_merge_key", "_row_size",
         "_mix_passes", "_MIX_copies", "_near_key", "_near_turn", "_id", "_y", "_at"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module", params=["rows", "clash", "empty"])
def table(request, docs):
    if request.param == "clash":
        return docs.withColumns({c: F.lit("x") for c in CLASH})
    return docs.where("false") if request.param == "empty" else docs


def count(table):
    return table.count()


def test_mix(table):
    out = mixing.mix(table).collect()
    assert len(out) == count(table)
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        if r["size"] == 0:
            assert r.taken == 0
    kept = mixing.mixed_documents(table)
    assert kept.columns == table.columns
    kept.count()


def test_simhash(table):
    out = simhash.near_duplicates(table).collect()
    assert len(out) == count(table)
    if out:
        zero = [r for r in out if r.fp == 0]
        assert len(zero) == 4 and {r.component_id for r in zero} == {2}
        assert {r.component_id for r in out if r.doc_id in (1, 6)} == {1}
    one = simhash.one_per_component(table)
    assert one.columns == table.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect())
    assert ids == sorted({(r.component_id is None, r.component_id or 0) for r in out})


def test_toxicity(spark, table):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, None), (None, 1, 1), (3, 0, 0), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(table, labels)
    out = toxicity.score_documents(table, model).collect()
    assert len(out) == count(table) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.without_toxic(table, model).columns == table.columns


def test_toxicity_sample(spark, monkeypatch):
    """Labels without a document take no room in the sample."""
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: fitted.append(sorted(zip(texts, labels))))
    labels = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    some = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    some = some.withColumn("text", F.when(F.col("doc_id") >= 100, F.col("text")))
    toxicity.train(some, labels, max_rows=200)
    known = [r[0] for r in labels.where(~toxicity.is_held_out(F.col("doc_id"))).where("doc_id between 100 and 399").collect()]
    assert len(fitted[0]) == 200 and {int(t) for t, _ in fitted[0]} <= set(known)
    toxicity.train(some, labels, max_rows=1000)
    assert fitted[1] == sorted((str(i), i % 2) for i in known)


def test_toxicity_repeated_id(spark, monkeypatch):
    """An id that repeats sends no more rows to the driver than the sample holds."""
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: fitted.append(texts))
    many = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    toxicity.train(many, labels.where(~toxicity.is_held_out(F.col("doc_id"))), max_rows=50)
    assert fitted[0] == sorted(map(str, range(20000)))[:50]


def test_merge_dropout(table):
    encoded = merge_dropout.encode_documents(table, PIECES)
    out = encoded.collect()
    assert len(out) == count(table) and all(r.lossless is True for r in out)
    back = merge_dropout.decode_documents(encoded.withColumn("was", F.coalesce("text", F.lit(""))), PIECES)
    assert back.where("text <> was or text is null").count() == 0


def test_token_files(spark, table, tmp_path):
    path = str(tmp_path / "f")
    token_files.write_token_files(table, path, BPE)
    out = token_files.token_digests(spark, path).orderBy("start").collect()
    assert len(out) == count(table)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in out if r.doc_id is not None] == sorted(r.doc_id for r in out if r.doc_id is not None)
    assert sum(r.n_tokens for r in token_files.read_token_files(spark, path).collect()) == at


def test_token_scan(table, tmp_path):
    written = token_scan.write_flat_files(table, str(tmp_path / "t"), BPE, 50256)
    files = written.where("path is not null").select("part", "path")
    small = token_scan.scan_flat_files(files, 50256, block=7).orderBy("part", "ordinal").collect()
    assert small == token_scan.scan_flat_files(files, 50256).orderBy("part", "ordinal").collect()
    assert len(small) == count(table) and all(r.ended for r in small)


def test_licenses(table):
    out = licenses.scan_licenses(table).collect()
    assert len(out) == count(table) and all(r.licenses == [] for r in out)


def test_order_minhash(table):
    out = fingerprints.edit_probe(table).collect()
    assert len(out) == count(table)
    by_text = {r.fingerprint for r in out if r.doc_id in (1, 6)}
    assert len(by_text) == (1 if out else 0)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprints.fingerprint_documents(table).count() == count(table)


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, 3, "tool|x", "\\<|end|>"),
            (None, None, None, None), (2, 1, "user", ""), (2, 1, "user", ""), (3, 1, "assistant", "[INST]\\</s" * 2000)]
    turns = spark.createDataFrame(rows, schema)
    for t in (turns, turns.withColumns({c: F.lit(1) for c in ("turns", "n", "starts", "blocks", "segments")})):
        out = {r.conv_id: r for r in chat.format_chats(t).withColumn("said", chat.parse_chat(F.col("formatted"))).collect()}
        for c in (1, 2, 3, None):
            want = sorted([(r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c])
            assert [(x.role, x.text) for x in out[c].said] == [w[1:] for w in want]
            assert "".join(s.text for s in out[c].segments) == out[c].formatted
    assert chat.format_chats(turns.where("false")).count() == 0


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [0.5, 0.5]), (9, [1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for v in (vectors, vectors.withColumns({c: F.lit(1) for c in ("vec", "id", "rep", "h", "head", "tree")})):
        out = [tuple(r) for r in ann.search(v, v, k=2).orderBy("query_id", "rank").collect()]
        assert out == [(1, 1, 2, 1.0), (1, 2, 8, 0.5), (2, 1, 1, 1.0), (2, 2, 8, 0.5), (8, 1, 1, 0.5), (8, 2, 2, 0.5)]
    none = vectors.where("false")
    assert ann.search(none, none).count() == 0
    copies = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    out = ann.search(copies, copies.where("vec_id % 20 = 0"), k=3).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 2, 3]


def test_stages(spark, table):
    sf_dir = "/root/testdata/sf0.001"
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, table, sf_dir)
        docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == table.columns
