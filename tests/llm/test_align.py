"""Alignment against a plain form over both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riftstats.llm import align
from riftstats.llm.pretoken import byte_alphabet

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair string, row int, links int"


def brute(texts):
    a_lib, b_lib = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    back = {c: b for b, c in byte_alphabet().items()}
    out, links = [], []
    for t in texts:
        a = b = []
        ends = [{}, {}]
        if t:
            a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
            spelt = [[bytes(back[c] for c in a_lib.id_to_token(i)) for i in a], []]
            for i in b:
                p = b_lib.id_to_piece(i)
                spelt[1].append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
            if any(b"".join(s) != (" " + t).encode() for s in spelt):
                a = b = []
            else:
                for side, s in enumerate(spelt):
                    at = 0
                    for k, x in enumerate(s):
                        at += len(x)
                        ends[side][at] = k
        own = [(ends[0][e], ends[1][e]) for e in sorted(ends[0]) if e in ends[1]]
        groups, i, j = [], 0, 0
        for x, y in own:
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        links.append([(a[x], b[y]) for x, y in own])
        out.append([len(a), len(b), len(own), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(p for own in links for p in own)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(*o[:4], sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), o[4]) for o, own in zip(out, links, strict=True)]


def texts():
    rng = random.Random(6)
    odd = [None, "", " ", "  two  spaces ", "\n\t", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト", "naïve café ﬁ ½", "▁ u2581", "a\x00b", "x" * 3000, "tail ", "😀 smile", "".join(map(chr, range(0x20, 0x250)))]
    words = "the of Haus señor where thouon eresan 12 3.5 it's über que".split()
    return odd + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)] + ["the of the"] * 5


@pytest.mark.parametrize("sent", [500_000, 3])
def test_align(spark, monkeypatch, sent):
    monkeypatch.setattr(align, "PAIRS_SENT", sent)
    docs, want = texts(), brute(texts())
    rows = spark.createDataFrame([(i, t, "p", 1, 2) for i, t in enumerate(docs)], SCHEMA).repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in align.align(rows, BYTE, PIECE).collect()}
    assert got == dict(enumerate(want))
    assert sum(n[0] > 0 for n in want) > 60


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "the house", "", 0, 0)] * 3 + [(None, "the tree", "", 0, 0)], SCHEMA)
    got = sorted((tuple(r) for r in align.align(docs, BYTE, PIECE).collect()), key=str)
    want = brute(["the house"] * 3 + ["the tree"])
    assert got == sorted([(1, *want[0])] * 3 + [(None, *want[3])], key=str)


def test_empty(spark):
    assert align.align(spark.createDataFrame([], SCHEMA), BYTE, PIECE).collect() == []
    got = align.align(spark.createDataFrame([(1, None, "", 0, 0)], SCHEMA), BYTE, PIECE).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_slices_and_spelling():
    """Against the plain forms, also with ends that several tokens of a side share."""
    import numpy as np

    rng = np.random.default_rng(3)
    aligner = align.Aligner(BYTE, PIECE)
    for _ in range(300):
        a_ends, b_ends = (np.cumsum(np.append(rng.integers(0, 4, rng.integers(0, 12)), 1)) for _ in "ab")
        a_ends[-1] = b_ends[-1] = max(a_ends[-1], b_ends[-1])
        a, b = rng.integers(0, 50_000, len(a_ends)), rng.integers(0, 32_000, len(b_ends))
        a_at, b_at = ({e: i for i, e in enumerate(ends.tolist())} for ends in (a_ends, b_ends))
        common = sorted(a_at.keys() & b_at.keys())
        x, y = align.slices(a_ends, b_ends)
        assert (x.tolist(), y.tolist()) == ([a_at[e] for e in common], [b_at[e] for e in common])
        want = [(a[i:p], b[j:q]) for i, p, j, q in zip([0, *x[:-1] + 1], x + 1, [0, *y[:-1] + 1], y + 1, strict=True)]
        assert aligner.spelt(a, b, x, y) == ";".join(f"{','.join(map(str, s))}|{','.join(map(str, t))}" for s, t in want)


def test_texts_of_pairs_are_not_remembered():
    """Spelling takes a table of ids, whose size doesn't grow with the pairs seen."""
    aligner = align.Aligner(BYTE, PIECE)
    assert len(aligner.spelt_ids) == 2 * (len(aligner.a_size) + len(aligner.b_size))
