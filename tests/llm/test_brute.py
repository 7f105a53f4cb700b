"""Operators against plain Python over small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from pyspark.sql import functions as F
from reelrank.llm import ann, licenses, merge_dropout, mixing, simhash, token_files, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def shingle_hash(text, k=3):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    array = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    docs = rows("documents")
    prints = [shingle_hash(d["text"]) for d in docs]
    root, first = components(prints), {}
    for d, r in zip(docs, root):
        first[r] = min(first.get(r, d["doc_id"]), d["doc_id"])
    want = {d["doc_id"]: (f"{p:016x}", first[r]) for d, p, r in zip(docs, prints, root)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in E.queries()["op5_simhash"](spark, SF).collect()}
    assert got == want


def test_simhash_links(spark):
    """Every pair within two bits, wherever the bits are, and no other."""
    base = 0x9D3A6C05F71E82B4
    prints = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a, 64, 5)} | {base ^ 7}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed
            if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert sorted((r.a, r.b) for r in found) == sorted(want)


def test_merge_dropout():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [d["text"] for d in rows("documents")][:60] + ["", "  a  b ", "日本語 テスト é", "x" * 300]
    plain = merge_dropout.Segmenter(path, 0.0)
    assert plain.encode_batch(texts, list(range(len(texts)))) == library.encode(texts)
    varied, fresh = merge_dropout.Segmenter(path, 0.1), merge_dropout.Segmenter(path, 0.1, room=0)
    together = varied.encode_batch(texts, [7] * len(texts))
    assert together != library.encode(texts) and library.decode(together) == texts
    for text, ids in zip(texts, together):      # one agenda at a time, by a heap
        alone = []
        for n, unit in enumerate(fresh.units("▁" + text.replace(" ", "▁")) if text else []):
            alone += fresh.agenda(unit, merge_dropout._mix((7 + n * merge_dropout.GOLDEN) & merge_dropout.MASK), fresh.threshold)[0]
        assert alone == ids
    assert varied.encode_batch(texts, [8] * len(texts)) != together


def test_remembered_units_are_small():
    """A remembered unit's ids are bytes, not Python integers."""
    segmenter = merge_dropout.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 0.1)
    texts = [d["text"] for d in rows("documents")][:60]
    segmenter.encode_batch(texts, list(range(60)))
    known = [ids for unit, (_, ids) in segmenter.known.items() if unit]
    assert len(known) > 100 and all(type(ids) is bytes for ids in known)


@pytest.mark.parametrize("query, end", [("op9_token_files", 0), ("op3_token_scan", 50256)])
def test_tokens(spark, query, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = {r.doc_id: r for r in E.queries()[query](spark, SF).collect()}
    at = 0
    for d in sorted(rows("documents"), key=lambda d: d["doc_id"]):
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [end]
        r = got[d["doc_id"]]
        assert r.n_tokens == len(ids)
        if query.startswith("op9"):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_encoder_encodes_a_unit_once(monkeypatch):
    """Words that repeat within and over calls go to the library once; texts
    of any spacing, and units forgotten for want of room, keep their ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = [d["text"] or "" for d in rows("documents")][:30] + [
        "", " ", "a", " a", "a ", "a  b", "a \nb", "\n", "a\nb c", " é\u00a0 x  <|endoftext|> y", "日本 語 ", "b b b b"]
    asked = []
    real = token_files.encode_words
    monkeypatch.setattr(token_files, "encode_words", lambda t, s, words: asked.extend(words) or real(t, s, words))
    for room in (1_000_000, 5):
        encode = token_files.encoder(path, 7, room)
        asked.clear()
        for some in (texts, texts[::-1], texts[:1], texts[-1:]):
            ids, sizes = encode(some)
            want = [whole.encode(t, add_special_tokens=False).ids + [7] for t in some]
            assert ids.dtype == np.uint32 and ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
        assert (len(asked) == len(set(asked))) == (room > 5)


def test_numbered_units():
    """Ids of all units stand in one array, not in an object each."""
    known = token_files.Numbered(9, room=2)
    assert list(known.add([4, 5, 6], [1, 1, 3])) == [1, 2, 3] and known.full()
    numbers = np.array([3, 0, 2, 1, 0])
    sizes = known.sizes(numbers)
    assert sizes.tolist() == [2, 1, 0, 1, 1] and known.joined(numbers, sizes).tolist() == [5, 6, 9, 4, 9]
    assert list(known.add(range(100_000), [100_000])) == [4] and known.sizes(np.array([4, 1])).tolist() == [100_000, 1]
    known.forget()
    assert not known.full() and known.n == 1


def test_encoder_keeps_used_units(monkeypatch):
    """Units that many calls use are not encoded again when room runs out, and
    the library gets new words in calls of bounded size."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    asked = []
    real = token_files.encode_words
    monkeypatch.setattr(token_files, "encode_words", lambda t, s, words: asked.append(words) or real(t, s, words))
    monkeypatch.setattr(token_files, "AT_ONCE", 2)
    encode = token_files.encoder(path, 7, room=16)         # seven units in each call, three in one call alone
    for n in range(30):
        texts = [f"x the of and w{n}a w{n}b", f"x of  the w{n}c"]
        ids, sizes = encode(texts)
        want = [whole.encode(t, add_special_tokens=False).ids + [7] for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    times = Counter(w for words in asked for w in words)
    assert times["the"] == times["of"] == times["and"] == 1 and len(times) == 3 + 2 * 30
    assert max(map(len, asked)) == 2


def test_numbered_units_kept():
    """At most half the room is kept, the units of most uses, with their ids."""
    known = token_files.Numbered(9, room=4)
    known.after = dict(zip("abcdef", known.add([1, 2, 2, 3, 3, 3, 4, 5, 6], [1, 3, 6, 7, 8, 9])))
    for n, units in enumerate(("abcdef", "abcef", "ce", "e", "e")):
        known.use(np.array([known.after[u] for u in units] * (1 + n)))
    known.forget_rare()
    assert known.after == {"c": 1, "e": 2} and known.n == 3 and known.uses[:4].tolist() == [0, 1, 2, 0]
    numbers = np.array([2, 0, 1])
    assert known.joined(numbers, known.sizes(numbers)).tolist() == [5, 9, 3, 3, 3]
    known.forget_rare()
    assert known.after == {"e": 1}
    known.forget_rare()
    assert known.n == 1 and not known.after


def test_chat(spark):
    said = defaultdict(list)
    for r in rows("conversations"):
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in E.queries()["op7_chat_format"](spark, SF).collect()}
    assert got.keys() == said.keys()
    for c, turns in said.items():
        turns.sort()
        lines = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def order_minhash(text, k=3, size=64):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return [0] * size

    def chain(parts, seed=42):
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed
    mask, seen, entries = (1 << 35) - 1, defaultdict(int), []
    for i in range(max(1, len(words) - k + 1)):
        h = chain(w.encode() for w in words[i:i + k]) & mask
        o = chain([h.to_bytes(8, "little"), seen[h].to_bytes(4, "little")]) & mask
        seen[h] += 1
        entries.append((o, i))
    out = []
    for c in range(size):
        origin = (mask + 1) * c // size
        least = sorted(entries, key=lambda e: ((e[0] - origin) % (mask + 1), e[1]))[:2]
        value = chain(o.to_bytes(8, "little") for o, _ in sorted(least, key=lambda e: e[1]))
        out.append(value >> 32)
    return out


def test_order_minhash(spark):
    docs = sorted(rows("documents"), key=lambda d: -d["doc_id"])
    got = {r.doc_id: r for r in E.queries()["op10_order_minhash"](spark, SF).collect()}
    assert len(got) == len(docs)
    prints = [order_minhash(d["text"]) for d in docs]
    for i, d in list(enumerate(docs))[:40] + [(len(docs) - 1, docs[-1])]:
        nxt = (i + 1) % len(docs)
        text, third = d["text"], len(d["text"]) // 3
        edited = text[:len(text) - third] + docs[nxt]["text"][:third]
        r, e = got[d["doc_id"]], order_minhash(edited)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:08x}" for x in prints[i])
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in e)
        assert r.near_edited == sum(a == b for a, b in zip(prints[i], e)) / 64
        assert r.near_next == sum(a == b for a, b in zip(prints[i], prints[nxt])) / 64


def test_nearest_recall(spark):
    vectors = sorted(rows("embeddings"), key=lambda v: v["vec_id"])
    ids, x = np.array([v["vec_id"] for v in vectors]), np.array([v["embedding"] for v in vectors], np.float64)
    found = defaultdict(list)
    for r in E.queries()["op8_nearest"](spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        near = found[ids[q]]
        hit += len({r.vec_id for r in near} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        assert [r.rank for r in near] == list(range(1, 21))
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in near)
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(near, near[1:]))
    assert hit >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("lengths", ["equal", "mixed"])
def test_nearest_recall_where_trees_prune(spark, lengths):
    """On 20,000 vectors, of one length or of log-normal ones."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "mixed":
        x *= np.exp(rng.normal(size=len(x)))[:, None]
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    asked = np.arange(0, len(x), 200)
    found = defaultdict(set)
    for r in ann.search(vectors, vectors.where(F.col("vec_id") % 200 == 0), k=20).collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit >= 0.9 * 20 * len(asked)


def test_nearest_ties(spark):
    """Fifty vectors of one product: the smallest ids, whatever the block does."""
    rng = np.random.default_rng(2)
    x = np.zeros((400, 8))
    x[:, 1:] = rng.integers(-3, 4, (400, 7))
    x[:, 0] = np.where(np.arange(400) % 8 == 3, 2.0, 1.0)
    order = rng.permutation(400)
    rows = [(int(i), [float(c) for c in x[i]]) for i in order] + [(1000, [1.0] + [0.0] * 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.where("vec_id = 1000"), k=20, share=8.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 2.0) for i in range(3, 400, 8)][:20]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in rows("labels", sf)}
    got = [r for r in E.queries()["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in got)
    caught = [r.predicted for r in got if labels[r.doc_id]]
    assert right >= 0.98 * len(got) and sum(caught) >= 0.85 * len(caught)


def test_noisy_or():
    texts = ["good day. nice tree.", "you idiot. nice tree.", "nice tree! good day.", "idiot day."] * 20
    model = toxicity.fit(texts, [0, 1, 0, 1] * 20)
    p, spans = toxicity.score("nice tree. you idiot! good day.", model, toxicity.WordWeights(model))
    assert p > 0.5 and [(a, b) for a, b, _ in spans] == [(10, 21)]
    assert toxicity.score("nice tree.", model, toxicity.WordWeights(model))[0] < 0.5


def test_licenses(spark):
    sf = "/root/testdata/sf0.01"
    notices = {"MIT": r"[Rr]eleased under the MIT License", "Apache": r"[Ll]icensed under the Apache License, Version \d",
               "GPL": r"work is licensed under the GNU General Public License", "CC-BY-NC": r"[Ll]icensed under CC BY-NC \d",
               "All rights reserved": r"All rights reserved"}
    got = {r.doc_id: r.licenses for r in E.queries()["op4_license_scan"](spark, sf).collect()}
    for d in rows("documents", sf):
        want = [n for n, p in notices.items() if re.search(p, d["text"])]
        assert sorted(filter(None, got[d["doc_id"]].split(","))) == sorted(want), d["doc_id"]


def test_license_rules(spark):
    bsd = [licenses.SENTENCES[i] for i in ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names")]
    cases = [". ".join(bsd), ". ".join(bsd[:3]) + ". x y", ". ".join([bsd[1], bsd[0], bsd[2]]),
             bsd[0] + ". a. b. c. " + ". ".join(bsd[1:]), "All rights\nreserved."]
    out = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string"))
    assert [r.licenses for r in out.orderBy("i").collect()] == [
        ["BSD-2-Clause", "BSD-3-Clause"], ["BSD-2-Clause"], [], [], ["All rights reserved"]]


MIT = """MIT License
{gap}Copyright (c) 2020 Jane Doe
{gap}Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
{gap}The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
{gap}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND
"""
BSD = """BSD 3-Clause License

Copyright (c) 2020, Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def found_licenses(spark, texts):
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    return [r.licenses for r in out.orderBy("i").collect()]


def test_wrapped_licenses(spark):
    mit = MIT.format(gap="\n")
    assert found_licenses(spark, [mit, mit.replace("\n", "\r\n"), BSD, BSD[:BSD.index("3. ")]]) == [
        ["MIT"], ["MIT"], ["BSD-2-Clause", "BSD-3-Clause"], ["BSD-2-Clause"]]


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_license_wording(spark):
    """Real notices, plain and as comments; notices inside a sentence."""
    gpl2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    notices = [(MIT.format(gap=""), ["MIT"]), (GPL, ["GPL"]), (gpl2, ["GPL"]), (MPL, ["MPL"]), (APACHE, ["Apache"]),
               (BSD, ["BSD-2-Clause", "BSD-3-Clause"])]
    for mark in ("", "# ", " * ", "// "):
        texts = ["".join(mark + line for line in t.splitlines(True)) for t, _ in notices]
        assert found_licenses(spark, texts) == [names for _, names in notices], mark
    inside = ["This project is released under the MIT License.", "Our code, licensed under the Apache License, Version 2.0, is free",
              "The photos are licensed under CC BY-NC 4.0 by their owners", "Copyright 2020 Jane Doe, all rights reserved",
              "My tool is licensed under the GNU General Public License v3.0", "unlicensed under the MIT Licenses"]
    assert found_licenses(spark, inside) == [["MIT"], ["Apache"], ["CC-BY-NC"], ["All rights reserved"], ["GPL"], []]
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())


def test_pipeline(spark):
    """Stage by stage in Python: who stays, how often, and with which ids."""
    docs = [d for d in rows("documents")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    known = toxicity.WordWeights(model)
    docs = [d for d in docs if toxicity.score(d["text"], model, known)[0] < 0.5]
    root = components([shingle_hash(d["text"]) for d in docs])
    first = {}
    for d, r in zip(docs, root):
        first[r] = min(first.get(r, d["doc_id"]), d["doc_id"])
    docs = sorted((d for d in docs if d["doc_id"] in set(first.values())), key=lambda d: hashlib.md5(f"1:{d['doc_id']}".encode()).hexdigest())
    size = {d["doc_id"]: len(WORDS.findall(d["text"])) for d in docs}
    source = defaultdict(int)
    for d in docs:
        source[d["source"]] += size[d["doc_id"]]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(source))}
    target, open_ = dict.fromkeys(source, 0.0), set(source)
    left = float(sum(source.values()))
    while left > 1e-6:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_):
            target[s] += share * weight[s]
            if target[s] > 3 * source[s]:
                left += target[s] - 3 * source[s]
                target[s] = 3.0 * source[s]
                open_.discard(s)
    passes, before = {}, defaultdict(int)
    for d in docs:
        s, n = d["source"], size[d["doc_id"]]
        budget = int(target[s] + 0.5)
        part = max(0, min(n, budget % source[s] - before[s]))
        passes[d["doc_id"]] = budget // source[s] + (part > 0 and 2 * part >= n)
        before[s] += n
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append(r)
    assert {k: len(v) for k, v in got.items()} == {k: v for k, v in passes.items() if v}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {d["doc_id"]: d["text"] for d in docs}
    for k, found in got.items():
        assert all(r.lossless and library.decode(r.piece_ids) == text[k] and r.n_pieces == len(r.piece_ids) for r in found)


def test_mix_targets(spark):
    out = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    assert abs(sum(r[0].target for r in by.values()) - sum(r["size"] for r in out)) < 1e-6
    for found in by.values():
        assert abs(sum(r.taken for r in found) - found[0].target) <= 0.5


def test_mixed_rows(spark):
    """Repeated ids with other texts and sources: every row has its own decision."""
    table = [(1, "a b c", "s"), (1, "d e f g", "s"), (1, "h i", "t"), (None, "x y", "s"), (None, "x y", "t"),
             (2, "k l", "u"), (2, "m n", "u"), (None, None, "s"), (None, None, None), (3, "o p q", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    once = mixing.mixed_documents(docs, weights=(1,), max_epochs=1).collect()
    assert Counter(map(tuple, once)) == Counter(table)
    many = table + [(4, "a b c d e", "s")] * 9 + [(5, "b c", "u")] * 7
    docs = spark.createDataFrame(many, "doc_id long, text string, source string")
    for seed in range(1, 4):
        want = Counter()
        for r in mixing.mix(docs, seed=seed).collect():
            want[r.doc_id, r["size"], r.source] += r.epochs + (r.part > 0 and 2 * r.part >= r["size"])
        got = Counter((r.doc_id, len((r.text or "").split()), r.source) for r in mixing.mixed_documents(docs, seed=seed).collect())
        assert got == +want
        assert mixing.mixed_documents(docs, seed=seed).where("text in ('a b c', 'd e f g')").groupBy("text").count().count() == sum(
            want[1, n, "s"] > 0 for n in (3, 4))
