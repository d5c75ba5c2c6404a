"""Packing: every id once and in order, little padding, least cost; ids against
the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riftstats.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, offset int"


def padded(n, width=2048):
    return 0 if n & (n - 1) == 0 else width - n


def texts():
    rng = random.Random(8)
    words = ["time", "Haus", "señor", "of", "12", "x" * 30, "日本", "“so”", "\n"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice([". ", "! ", "?\n"])
    return [None, "", " ", "a <|endoftext|> b<|endoftext|><|endoft", "q" * 9000, "日本語" * 4000, "word " * 9000, *["".join(line(rng.randrange(2, 25)) for _ in range(rng.choice([1, 3, 40, 300]))) for _ in range(150)]]


@pytest.mark.parametrize("chunk", [400_000, 10_000])
def test_pieces(spark, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    lib, docs = Tokenizer.from_file(BYTE), texts()
    docs += docs[:9]
    ids = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for t in docs]
    got = packing.pack(spark.createDataFrame([(None if i == 11 else i, t, "x", 1) for i, t in enumerate(docs)], SCHEMA).repartition(3), BYTE).collect()
    own, sequences = {}, {}
    for r in got:
        own.setdefault(11 if r.doc_id is None else r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert own.keys() == set(range(len(docs)))
    for i, pieces in own.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : at].astype("<u4").tobytes())
        assert at == len(ids[i])
    waste = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        waste += padded(at)
    assert waste <= 0.01 * sum(map(len, ids))


def test_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(60):
        width = 16
        ends = np.cumsum([rng.randrange(1, 7) for _ in range(rng.randrange(1, 25))])
        costs = np.array([rng.choice([0, 4, 12]) for _ in ends])
        best = {0: 0}
        for e, c in zip(ends.tolist(), costs.tolist(), strict=True):
            best[e] = min(best[s] + padded(e - s, width) + c + packing.SEQUENCE for s in best if e - s <= width)
        took, at = 0, 0
        for k in packing.cuts(ends, costs, width):
            took += padded(int(ends[k]) - at, width) + int(costs[k]) + packing.SEQUENCE
            at = int(ends[k])
        assert at == ends[-1] and took == best[at]


def test_sentences_stay_whole_where_they_can(spark):
    """Nearly all cuts within documents are at the ends of sentences."""
    lib, rng = Tokenizer.from_file(BYTE), random.Random(1)
    docs = ["".join("the house of time and more "[: rng.randrange(9, 27)] + "ends. Then " for _ in range(400)) for _ in range(20)]
    got = packing.pack(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(docs)], SCHEMA).coalesce(1), BYTE).collect()
    inner = [lib.encode(docs[r.doc_id]).ids[r.start - 1] == 13 for r in got if r.start]
    assert len(inner) > 5 and sum(inner) >= len(inner) - 6


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, BYTE).collect() == []
    again = lambda: sorted(map(tuple, packing.pack(spark.createDataFrame([(1, "a b c", "", 0)] * 5, SCHEMA).coalesce(1), BYTE).collect()))
    assert again() == again() and len({(r[5], r[6]) for r in again()}) == len(again())
    with pytest.raises(ValueError, match="power"):
        packing.pack(none, BYTE, width=1000)
