"""Held-out accuracy of language ID, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from riftstats.llm import langid


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.count(), got.where(F.col("lang") == F.col("lang_pred")).count()
    assert n > 100 and right >= 0.97 * n


def test_signs_that_are_no_letters(spark):
    assert all(not list(langid.pieces(t)) for t in ("\u00bd \u00b2", "\u2460\u2461", "\u2167", "12 _ !", "\u0663"))
    base = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("el perro y el gato", "es")] * 20)]
    df = spark.createDataFrame([*base, (100, "\u00bd \u2461", None), (101, "\u2167", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).where("doc_id >= 100").collect()] == [("und", 0.0)] * 2


def test_against_plain_kernel_ridge(spark):
    """Exact n-gram sets, the kernel matrix and the ridge system written out."""
    rows = [(r.lang, r.text[:600]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and text is not null").orderBy("doc_id").limit(120).collect()]
    model = langid.Model(rows)

    def grams(text):
        line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return {line[i : i + n] for n in langid.NGRAMS for i in range(len(line) - n + 1)} if line.strip() else set()

    marks, seen = [], {}
    for lang, text in rows:
        if seen.setdefault(lang, 0) < langid.LANDMARKS_PER_LANG:
            seen[lang] += 1
            marks.append(grams(text))
    usual = np.mean([len(m) for m in marks])
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    short = lambda a: np.sqrt(max(1, usual / max(1, len(a))))
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = value > langid.FLOOR
    to_phi = vector[:, keep] / np.sqrt(value[keep])
    phi = lambda text: np.append(np.array([kernel(g, m) for m in marks]) * short(g) @ to_phi, 1) if (g := grams(text)) else None
    x = np.stack([phi(t) if grams(t) else np.append(np.zeros(keep.sum()), 1) for _, t in rows])
    y = np.array([[1.0 if lang == z else -1.0 for z in model.langs] for lang, _ in rows])
    c = 1 / np.array([sum(lang == z for z, _ in rows) for lang, _ in rows])
    c *= len(rows) / c.sum()
    w = np.linalg.solve(x.T @ (x * c[:, None]) + langid.RIDGE * np.eye(x.shape[1]), x.T @ (y * c[:, None]))
    texts = [r.text[:3000] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").limit(150).collect()]
    langs, score = model(texts)
    for text, lang, s in zip(texts, langs, score, strict=True):
        p = phi(text)
        if p is None:
            assert lang == "und" and s == 0
            continue
        f = p @ w
        assert abs(s - np.clip((f.max() + 1) / 2, 0, 1)) < 0.02  # n-grams share cells now and then
        assert lang == model.langs[int(f.argmax())] or np.diff(np.sort(f)[-2:])[0] < 0.05


def test_labels_and_ids_are_no_inputs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(df)
    texts = [r.text for r in df.limit(50).collect()]
    assert model(texts)[0] == [model([t])[0][0] for t in texts]


def test_odd_rows(spark):
    base = [(i, t, lang, "x", 0.5) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et la souris", "fr")] * 20)]
    odd = [(100, None, "en", "x", 0.1), (101, "", None, "x", 0.1), (102, "123 456 !!", "en", "x", 0.1), (None, "the dog and the cat", "en", "x", 0.1), (104, "le chat " * 40_000, None, "x", 0.1), (104, "le chat", None, "x", 0.1)]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(base) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[None].lang_pred == "en" and by[104].lang_pred == "fr" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first().lang_pred == "und"
    assert langid.identify(df.where("false")).count() == 0


def test_length_is_no_reason_to_reject(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    joined = {}
    for r in docs.where("lang is not null and text is not null").orderBy("doc_id").select("lang", "text").collect():
        joined.setdefault(r.lang, []).append(r.text)
    langs = sorted(joined)
    long = spark.createDataFrame([(-1 - i, "\n".join(joined[x])[:3_000_000], None, "s", 0) for i, x in enumerate(langs)], docs.schema)
    assert all(r.n > 2_000_000 for r in long.selectExpr("length(text) n").collect())
    short = docs.where("length(text) < 200 and text rlike '[a-zA-Z]'")
    small = docs.where("doc_id % 5 = 0").unionByName(short.where("doc_id % 5 <> 0"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, small.unionByName(long), "").select("doc_id").collect()}
    assert kept >= {-1 - i for i in range(len(langs))} and kept >= {r.doc_id for r in short.select("doc_id").collect()}
    got = {r.doc_id: r for r in langid.identify(small.unionByName(long)).where("doc_id < 0").collect()}
    assert [got[-1 - i].lang_pred for i in range(len(langs))] == langs and min(r.score for r in got.values()) > 0.8
