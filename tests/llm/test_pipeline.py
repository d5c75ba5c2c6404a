"""The pipeline against the stages' brute-force versions."""

import importlib.util
from collections import Counter

import pytest
from tokenizers import Tokenizer

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline
import public_tokenizers
from test_pii import slow_added, slow_spans
from test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            assert set(now) == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
        if k == 1:
            parts = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
            assert set(now) == {i for i, c in parts.items() if i == c}
        if k == 2:
            flat = lambda s: " ".join(s.split())
            assert set(texts) - set(now) == {i for i, t in texts.items() if any(flat(b) in flat(t) for b in bench)}
        if k == 3:
            assert set(now) == set(texts)
            for i, t in texts.items():
                assert (now[i].text == t) == (not slow_spans(t) and not slow_added(t)) and not slow_spans(now[i].text) and not slow_added(now[i].text) and now[i].n_chars == len(now[i].text)
        if k == 4:
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert {i: r.ids for i, r in now.items()} == {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
        else:
            texts = {i: r.text for i, r in now.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == {i: r.ids for i, r in now.items()}


def test_odd_documents(spark):
    rows = [(1, None, None, "s", None), (2, "", "en", "s", 0), (None, "some words without an id", "en", "s", 1), (4, "words of a text " * 3000, "en", None, 5), (5, "12345", "en", "s", 5), (6, "une phrase de mots", "fr", "s", 9), (6, "une phrase de mots", "fr", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or -1 for r in docs.collect()) == [-1, 4, 6]
    assert Counter(r.doc_id for r in docs.collect())[6] == 1
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_clashing_columns_and_rows(spark):
    """Columns that the stages use names of, ids with several texts, and no ids."""
    one, two = "some words of a first text about a house", "other phrases on ships and trains at sea"
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, one), (1, two), (None, one), (7, two), (None, bench), (9, "a third text that stands alone here, to the end")]
    names = ["pii", "language", "_language", "_n", "place", "row_key", "key", "fp", "root", "component_id", "item_id", "score"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[f"{n}!" for n in names]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        docs = out
    got = docs.collect()
    assert all(r[n] == f"{n}!" for r in got for n in names)
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, one), (1, two), (9, rows[-1][1])])
