"""Benchmark decontamination against a plain search for every window."""

import hashlib
import random
import re

import pyarrow.parquet as pq

import __spark_entry__ as E
from reelrank.llm import decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain(texts, items, window=10):
    """(n_words, hit word spans as code points, item ids) of each text."""
    cut = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            cut.setdefault(tuple(words[i:i + window]), set()).add("" if item is None else str(item))
    for text in texts:
        spans, words = [m.span() for m in WORD.finditer(lower(text))], WORD.findall(lower(text))
        hit, found = set(), set()
        for n in {len(w) for w in cut}:
            for i in range(len(words) - n + 1):
                if here := cut.get(tuple(words[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= here
        yield len(words), {spans[i] for i in hit}, sorted(found)


def check(rows, texts, items, **kw):
    left = sorted((n, sorted(hit), found) for n, hit, found in plain(texts, items, **kw))
    by_text = []
    for r in rows:
        text = texts[r.doc_id]
        covered = [m.span() for m in WORD.finditer(lower(text))
                   if any(h.start <= m.start() and m.end() <= h.end for h in r.hits)]
        assert r.n_hit == len(covered) == sum(h.word_end - h.word for h in r.hits)
        by_text.append((r.n_words, covered, r["items"]))
    assert sorted(by_text) == left


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = {}
    for d, (n, hit, found) in zip(docs, plain([d["text"] for d in docs], items)):
        want[d["doc_id"]] = (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in E.queries()["op12_decontaminate"](spark, SF).collect()}
    assert got == want and any(w[4] for w in want.values())


def test_small_alphabet(spark):
    """Overlapping, nested and repeated windows of few words, in one automaton and in many."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "ñ ", "日", " ", ", ", "\n", "\x00"]) for _ in range(rng.randrange(60)))
             for _ in range(60)] + [None, "", " ,.", "a" * 5000, "a " * 3000, "A b, ñ! a b"]
    items = [(rng.choice([1, 2, 3, 10, None]), "".join(rng.choice(["a ", "b ", "ñ ", "日 "]) for _ in range(rng.randrange(7))))
             for _ in range(14)] + [(4, None), (5, ""), (6, "..."), (7, "B"), (7, "a b")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, items string")
    bench = spark.createDataFrame(items, "item_id int, text string").withColumnRenamed("text", "words")
    for most in (100_000, 7):
        rows = decontaminate.scan_documents(docs, bench, window=4, max_windows=most, item_text="words").collect()
        check(rows, texts, items, window=4)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "B c")], "item_id int, text string")
    for most in (100_000, 1):
        more = bench.unionByName(spark.createDataFrame([(8, "c")], bench.schema))
        rows = decontaminate.scan_documents(docs, more, max_windows=most).collect()
        assert sorted((r.doc_id or 0, r.n_hit, tuple(r["items"])) for r in rows) == [
            (0, 2, ("8", "9")), (1, 0, ()), (1, 2, ("8", "9")), (1, 2, ("8", "9"))]
    assert [r.n_hit for r in decontaminate.scan_documents(docs, bench.limit(0)).collect()] == [0] * 4
    assert decontaminate.scan_documents(docs.limit(0), bench).count() == 0
