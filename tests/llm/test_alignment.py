"""Tokenizer alignment against whole-text encoding by the libraries."""

import hashlib
import random
from collections import Counter
from functools import reduce

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from reelrank.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HOSTILE = [None, "", " ", "  a  b ", "a▁b c", "日本語 テスト é\n  x", "x" * 3000, "<|endoftext|> </s> <0x41> <s>",
           "a\x00b\tc\x1c d", "it's  we'll\n\n 12 a", "👩‍👩‍👧 " * 50, "ab " * 700 + "y" * 900 + " tail"]


def plain(texts):
    """(groups text, links) of each text, over whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    char = {c: x for x, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)],
                                 map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    for n, x in enumerate(x for x in range(256) if x not in set(char.values())):
        char[chr(256 + n)] = x
    entry = {i: bytes(char[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    piece = [p.replace("▁", " ").encode() if not b.is_byte(i) else bytes([int(p[3:5], 16)])
             for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    for text in texts:
        groups, links = [], []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            data = " ".encode() + text.encode()
            if b"".join(entry[i] for i in ids[0]) == data == b"".join(piece[i] for i in ids[1]):
                ends = []
                for some, table in zip(ids, (entry, piece)):
                    at, found = 0, []
                    for i in some:
                        found.append(at := at + len(table[i]))
                    ends.append(found)
                common = sorted(set(ends[0]) & set(ends[1]))
                for low, high in zip([0, *common], common):
                    run = [[i for i, e in zip(*x) if low < e <= high] for x in zip(ids, ends)]
                    groups.append("|".join(",".join(map(str, r)) for r in run))
                    links.append((run[0][-1], run[1][-1]))
        yield ids if groups else ([], []), groups, links


def report(texts):
    rows = list(plain(texts))
    count = Counter(link for _, _, links in rows for link in links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for ids, groups, links in rows:
        yield (len(ids[0]), len(ids[1]), len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
               sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def tuple_of(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = {d["doc_id"]: w for d, w in zip(docs, report([d["text"] for d in docs]))}
    assert {r.doc_id: tuple_of(r) for r in E.queries()["op13_align_tokenizers"](spark, SF).collect()} == want


def test_hostile_and_ranges(spark):
    """Any length of byte ranges and any tree give the same as whole texts."""
    texts = HOSTILE + HOSTILE[5:7]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a b", "x", "y")],
                                 "doc_id int, text string, key string, groups string")
    want = dict(enumerate(report([*texts, "a b"])))
    want[None] = want.pop(len(texts))
    for most, fan in ((1 << 16, 16), (40, 3)):
        got = {r.doc_id: tuple_of(r) for r in alignment.alignment_report(docs, A, B, chunk_bytes=most, fan=fan).collect()}
        assert got == want
    assert alignment.alignment_report(docs.limit(0), A, B).count() == 0


def test_groups_parse(spark):
    docs = spark.createDataFrame([(1, "Some words, aligned"), (2, "")], "doc_id int, text string")
    out = alignment.align_documents(docs, A, B).withColumn("parsed", alignment.parse_groups(F.col("groups")))
    for r in out.collect():
        assert ";".join("|".join(",".join(map(str, x)) for x in g) for g in r.parsed) == r.groups


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def test_monoid(aligner):
    """Bytes cut anywhere compose to the whole in any order; the empty fragment is neutral."""
    rng, size = random.Random(3), aligner.size_b
    for text in ("a\tbc, déjà-vu 12345 日本語 tokenization", "uncommonwordwithoutspaces 👩‍👩‍👧!!", "é" * 40):
        total = len((" " + text).encode())
        want = aligner.documents([text])[0]
        for _ in range(20):
            cuts = sorted(rng.sample(range(1, total), 5))
            parts = [aligner.fragment(" " + text, a, b) for a, b in zip([0, *cuts], [*cuts, total])]
            left = reduce(lambda x, y: alignment.compose(x, y, size), parts)
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i:i + 2] = [alignment.compose(parts[i], parts[i + 1], size)]
            assert parts[0] == left == alignment.compose(alignment.EMPTY, left, size) == alignment.compose(left, alignment.EMPTY, size)
            assert alignment.whole(left, size) == want
            assert (left.right_a, left.right_b) == ("", "")


def test_units_match_library(aligner):
    texts = [t for t in HOSTILE if t]
    for text, body in zip(texts, aligner.documents(texts)):
        want, = plain([text])
        assert body.groups == ";".join(want[1]), text
    assert len({x for _, _, links in plain(texts) for x in links}) <= aligner.most_links() < 1_000_000
