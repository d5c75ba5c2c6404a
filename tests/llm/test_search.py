"""Nearest neighbours and decontamination against brute force."""

import math
import random

import numpy as np
import pytest

from riftstats.llm import ann, decontaminate


def rows(rng, n, dim=16):
    return [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]


def brute(vectors, queries, k=5):
    out = {}
    for q, v in queries:
        if v is None or not any(x for x in v if x is not None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        best = []
        for i, w in vectors:
            if i == q or i is None or w is None or len(w) != len(v) or any(x is None or not math.isfinite(x) for x in w) or not any(w):
                continue
            best.append((-float(np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w))), i))
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in best)[:k]]
    return {q: x for q, x in out.items() if x}


SCHEMA = "vec_id long, embedding array<double>, v int, bucket string"


def test_recall_and_scores(spark):
    vs = rows(np.random.default_rng(1), 600)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vs], SCHEMA)
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(vs, [x for x in vs if x[0] % 20 == 0])
    hits = sum(len(set(want[q]) & {i for i, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    at = dict(vs)
    for q, found in got.items():
        assert sorted(found) == list(range(1, len(found) + 1))
        scores = [s for _, (_, s) in sorted(found.items())]
        assert scores == sorted(scores, reverse=True)
        for i, s in found.values():
            assert abs(s - np.dot(at[q], at[i]) / math.sqrt(np.dot(at[q], at[q]) * np.dot(at[i], at[i]))) < 1e-12 and i != q


@pytest.mark.parametrize("n", [300, 1500, 6000])
def test_recall_at_three_sizes(spark, n):
    """Random vectors and groups of close ones, with the settings that are tuned
    to each table."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 16))
    base[: n // 2] = base[rng.integers(0, n // 20, n // 2)] + 0.1 * rng.normal(size=(n // 2, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(4)
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = unit[::50] @ unit.T
    near[np.arange(len(near)), np.arange(0, n, 50)] = -2
    top = np.argsort(-near, axis=1)[:, :5]
    assert sum(len(set(top[i].tolist()) & got.get(i * 50, set())) for i in range(len(top))) >= 0.9 * top.size


def test_order_of_visits():
    rng = np.random.default_rng(5)
    for k in (1, 2, 4):
        at = rng.normal(size=k) * 3
        steps = ann.perturbations(at - np.floor(at), 3**k)
        assert ann.visit_ranks(at, np.stack([np.floor(at) + s for s in steps])).tolist() == list(range(3**k))
        assert (ann.visit_ranks(at, np.floor(at)[None, :] + 2) > 3**k).all()


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    same = [float(x) for x in rng.normal(size=8)]
    vs = [(i, same) for i in range(40)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0] * 7 + [float("inf")]), (104, [None] + [1.0] * 7), (None, same), (105, [1.0, 2.0])] + [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200, 230)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vs], SCHEMA)
    for block in (512, 3):
        got: dict = {}
        for r in ann.nearest(df, df.where("vec_id in (0, 3, 39, 100, 101, 102, 105)"), setting=ann.Setting(4, 4, 1.3, 81), block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 39: [0, 1, 2, 3, 4]}


def test_ann_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, none).count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(n)]


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randrange(12, 60)))) for i in range(70)] + [(90, None), (91, ""), (92, "two words"), (None, "no id at all here")]
    docs, want = [], set()
    for d in range(120):
        w = words(rng, rng.randrange(0, 900))
        if d % 3 == 0:
            i = rng.randrange(70)
            at = rng.randrange(len(w) + 1)
            w[at:at] = items[i][1].upper().split() if d % 2 else items[i][1].split()
            want.add((d, i))
        docs.append((d, "\n".join(w), 0, "x"))
    docs += [(500, None, 0, "x"), (501, "", 0, "x"), (None, items[5][1], 0, "x")]
    want.add((None, 5))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= want
    assert {(r.doc_id, r.item_id) for r in got} - want <= {(r.doc_id, 92) for r in got}
    assert all(r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in got)


def test_block_bounds_lose_nothing():
    """What block-max WAND retrieves is all that plain BM25 finds."""
    rng = random.Random(6)
    texts = {i: words(rng, rng.randrange(8, 30)) for i in range(100)}
    terms = sorted({t for w in texts.values() for t in w})
    weight = {(t, i): (1 + rng.random()) for i, w in texts.items() for t in set(w)}
    own = {i: sum(weight[t, i] for t in set(w)) for i, w in texts.items()}
    rows = [(t, i, weight[t, i] / own[i]) for t in terms for i in texts if (t, i) in weight]
    index = decontaminate.Index(*zip(*rows, strict=True), texts, 128)
    docs = [words(rng, 40) + texts[d] for d in range(30)]
    found = {(d, i) for d, i, *_ in index.search(docs)}
    for d, w in enumerate(docs):
        for i in texts:
            s = sum(weight[t, i] / own[i] for t in set(w) if (t, i) in weight)
            if s >= decontaminate.THRESHOLD and " ".join(texts[i]) in " ".join(w):
                assert (d, i) in found


@pytest.mark.parametrize("table", [0, decontaminate.TABLE_CELLS])
def test_scores_of_a_large_index(monkeypatch, table):
    """100,000 items in 3,125 blocks: the items at or above the threshold and
    their scores are those of plain BM25, passage by passage; no more than CELLS
    bounds are held, with the table of entries and without."""
    monkeypatch.setattr(decontaminate, "TABLE_CELLS", table)
    monkeypatch.setattr(decontaminate, "CELLS", 4 * 3125)
    rng = np.random.default_rng(3)
    n, vocabulary = 100_000, 4000 if not table else 2000
    counts = rng.integers(6, 14, n)
    item = np.repeat(np.arange(n), counts)
    term = (vocabulary * rng.random(len(item)) ** 3).astype(int)  # a few common terms, many rare ones
    pair = np.unique(item * vocabulary + term)
    item, term = pair // vocabulary, pair % vocabulary
    idf = np.log(1 + n / np.bincount(term, minlength=vocabulary).clip(1))[term]
    weight = idf / np.bincount(item, idf)[item]
    texts = {i: [] for i in range(n)}
    for i, t in zip(item.tolist(), term.tolist(), strict=True):
        texts[i].append(f"t{t}")
    index = decontaminate.Index([f"t{t}" for t in term.tolist()], item, weight, texts, 128)
    assert index.n_blocks == 3125 and (index.table is None) == (table == 0)
    passages = [sorted(set(rng.integers(0, vocabulary, 30).tolist()) | set(term[item == rng.integers(n)].tolist())) for _ in range(25)]
    rows = [(p, index.term[f"t{t}"]) for p, ts in enumerate(passages) for t in ts if f"t{t}" in index.term]
    rows.sort()
    got = {}
    for lo in range(0, 25, 4):
        part = [r for r in rows if lo <= r[0] < lo + 4]
        got |= {(p, index.items[i]): s for p, i, s in index.scored(*map(np.array, zip(*part, strict=True)))}
    want = {}
    for p, ts in enumerate(passages):
        some = np.isin(term, ts)
        score = np.bincount(item[some], weight[some], minlength=n)
        want |= {(p, int(i)): score[i] for i in np.flatnonzero(score >= decontaminate.THRESHOLD)}
    assert len(want) > 25 and set(got) == set(want)
    assert max(abs(got[x] - want[x]) for x in want) < 1e-9


def test_items_are_known_by_id_and_words(spark):
    one, two, three = ("the first long question of an item with its answer", "another wholly different question and its other reply", "a third text without any number that is contaminated")
    bench = spark.createDataFrame([(1, one), (1, two), (1, one), (None, three)], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"x y z {one} u"), (11, f"x {two} z"), (12, f"{three}"), (13, "clean words only in this one")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id or -1) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(10, 1), (11, 1), (12, -1)]


def test_shards_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    bench = spark.createDataFrame([(i, " ".join(words(rng, 20))) for i in range(60)], "item_id long, text string")
    texts = [r.text for r in bench.collect()]
    docs = spark.createDataFrame([(i, " ".join(words(rng, 50)) + " " + texts[i] + " " + " ".join(words(rng, 300))) for i in range(60)], "doc_id long, text string").repartition(3)
    plain = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, bench).collect())
    want = plain()
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 300)
    assert len(want) >= 60 and plain() == want


def test_decontamination_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([(1, "some test item text of words")], "item_id long, text string")).count() == 0


def test_vectors_that_no_hash_separates_are_all_looked_at(spark, monkeypatch):
    monkeypatch.setattr(ann, "TUNED_RECALL", 2.0)  # more than any setting finds
    vectors = rows(np.random.default_rng(3), 300)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 50 = 0")
    index = ann.valid(df, "vec_id", "embedding")
    assert ann.tuned(index, ann.valid(queries, "vec_id", "embedding"), 5) == ann.WHOLE
    got: dict = {}
    for r in sorted(ann.nearest(df, queries).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(vectors, [v for v in vectors if v[0] % 50 == 0])


def test_frequent_keys_are_sent_out(spark):
    from riftstats.llm.base import join_by_key

    left = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 3), ("c", 1), ("z", 1)) for i in range(n)], "key string, i int")
    side = spark.createDataFrame([("a", 1, 50), ("b", 2, 3), ("c", 3, 1)], "key string, v int, n int")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(side.drop("n"), "key", how).collect()))
        for sent in (1, 100):
            assert sorted(map(str, join_by_key(left, side, "key", "n", how, sent).collect())) == want
