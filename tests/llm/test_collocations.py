"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import __spark_entry__ as E
from reelrank.llm import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, top, keep_below=80):
    count, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = count.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in count.items():
        chosen, longer = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, Counter()
        for p, a in chosen.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        found = []
        for p, a in chosen.items():
            if 100 * longer[p] < keep_below * a or not longer[p]:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, x, y, n[lang], -score))
    return out


def check(spark, rows, least, top, **kw):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, prefix string")
    got = collocations.collocations(docs, least=least, top=top, **kw).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(plain(rows, least, top))


def test_small_alphabet(spark):
    """Every setting of blocks, bitmaps and segments gives the same rows."""
    rng = random.Random(1)
    word = ["A", "b", "c", "ñ", "日本", "d\x00", "e", "f\x1c", " "]
    rows = [(rng.choice(["en", "fr", None, "und", ""]),
             "".join(rng.choice(word[:1 + rng.randrange(len(word))]) + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "?!"])
                     for _ in range(rng.randrange(40)))) for _ in range(150)]
    rows += [("en", None), (None, ""), ("en", " ..\t"), ("fr", "a " * 500), ("fr", "b c " * 300), ("fr", "b c " * 300)]
    check(spark, rows, 5, 1000, block_words=50, share=5)
    check(spark, rows, 8, 7, max_bits=64)


def test_query(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["lang", "text"]).to_pylist()]
    got = {tuple(r[c] for c in COLUMNS) for r in E.queries()["op11_collocations"](spark, sf).collect()}
    assert got == plain(rows, 30, 2000) and got


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    check(spark, [("en", "a b"), ("en", None)], 30, 10)
