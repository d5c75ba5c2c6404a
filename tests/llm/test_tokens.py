"""BPE encoding and token counts against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riftstats.llm import bpe, tokencount

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\t", "ΣΑΣ İstanbul ﬁ", "a\x85b\xa0c\x1cd\x1fe", "<|endoftext|>x<|startoftext|> y <|endoftext|", "aaaaaaaa 'S 's' it's", "日本語 テキスト", "".join(map(chr, range(0x250))), " ".join(map(chr, range(0x250))), "ab" * 5000, "the " * 3000]
    for _ in range(150):
        out.append("".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x250), rng.randrange(0x20, 0x3000)])) for _ in range(rng.randrange(60))))
    return out + ["the " * 3, "the " * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(odd_texts())] + [(None, "no id", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_bpe_round_trip(docs):
    lib = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(docs, WORD), "ids").collect()}
    assert len(got) == docs.count()
    for i, t in enumerate(odd_texts()):
        e = lib.encode(t or "", add_special_tokens=False)
        assert got[i].ids == e.ids and got[i].n_tokens == len(e.ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_slices_and_forgetting_change_nothing(monkeypatch):
    texts = [t for t in odd_texts() if t]
    whole = bpe.Encoder(bpe.load(WORD))(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    encoder = bpe.Encoder(bpe.load(WORD))
    for t, (ids, decoded) in zip(texts, whole, strict=True):
        again = encoder([t])[0]
        assert again[0].tolist() == ids.tolist() and again[1] == decoded


def test_decode_of_ids(docs):
    encoded = bpe.encode_decode(docs, WORD)
    both = bpe.decode(encoded.select("doc_id", "ids", encoded["decoded"].alias("want")), WORD)
    assert both.where("decoded <> want").count() == 0


def test_token_counts(docs):
    lib = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, BYTE).collect()}
    for i, t in enumerate(odd_texts()):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)
    assert got[None].n_tokens > 0


def test_shortcuts_are_proved():
    b = tokencount.ByteBpe(BYTE)
    lib = Tokenizer.from_file(BYTE)
    whole = sorted(b.whole())
    assert len(whole) > 40_000
    for t in whole[::997]:
        assert len(lib.encode(t, add_special_tokens=False).ids) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode_decode(none, WORD)).count() == 0
    assert tokencount.count_tokens(none, BYTE).count() == 0
