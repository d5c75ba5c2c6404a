"""Ranked search against a plain form of the formula."""

import math
import random
import re
from collections import Counter

import pytest

from riftstats.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for i, asked in own.items():
        got = []
        for d, c, size in held:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                got.append((-score, d is None, d or 0))
        out += [(i, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(got)[:k], 1)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made(rng, n):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [(i, " ".join(rng.choice(words) + rng.choice(["", ",", " İß日本", "É"]) for _ in range(rng.choice([3, 8, 8, 30, 300])))) for i in range(n)]


DOCS, ITEMS = "doc_id long, text string, score int, m string, item string", "item_id long, text string, term int"


@pytest.mark.parametrize(("block", "cells"), [(256, 4_000_000), (7, 50)])
def test_search(spark, monkeypatch, block, cells):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "CELLS", cells)
    rng = random.Random(4)
    docs = made(rng, 300)
    docs += docs[:40] + [(1000 + i, docs[5][1]) for i in range(60)] + [(7, None), (8, ""), (9, " .,;\n"), (None, docs[3][1]), (2000, "w1 " * 30_000 + "rare")]
    items = [(i, docs[i * 7][1][:80].upper()) for i in range(30)] + [(40, "rare"), (41, "nowhere"), (42, None), (43, " - "), (1, docs[9][1]), (1, docs[9][1]), (None, docs[11][1])]
    got = search.search(spark.createDataFrame([(*d, 1, "x", "y") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, 2) for i in items], ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(docs, items), key=key)
    assert got[0].asDict().keys() == {"item_id", "rank", "doc_id", "score"}


def test_lots_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    docs, items = made(rng, 120), [(i, f"w1 w{i} w{2 * i}") for i in range(25)]
    monkeypatch.setattr(search, "LOT_TERMS", 20)
    got = search.search(spark.createDataFrame([(*d, 1, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, 2) for i in items], ITEMS)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, items))


def test_empty(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 1)], ITEMS)
    assert search.search(none, one).collect() == []
    assert search.search(spark.createDataFrame([(1, "a b", 1, "", "")], DOCS), one.where("false")).collect() == []
    assert search.search(spark.createDataFrame([(1, " ", 1, "", "")], DOCS), one).collect() == []


def test_visits_are_left_out():
    """Blocks are passed over by their bounds, and the best are found all the same."""
    import numpy as np

    rng = np.random.default_rng(1)
    asked = search.Asked([0, 1], np.array([0, 0, 1]), np.array([0, 2, 1]), np.array([50.0, 900.0, 10.0]), np.array([0, 2, 3]), np.zeros(2))
    for m in (10, 400):
        tf = np.sort(rng.integers(1, 5, 12))[::-1].astype(np.int32)
        term, post = np.repeat([0, 1, 2], 4).astype(np.int32), np.tile(np.arange(4), 3).astype(np.int32)
        order = np.lexsort((-tf, term))
        block = search.Block(m, [5, 6, 7, 8], term[order], tf[order], np.arange(1, 13, dtype=np.int32), post[order])
        scores = [r[1] for r in block.best(asked, np.array([0]), np.zeros(2), 4)]
        assert max(scores) <= block.bounds(asked)[0]
        assert list(block.best(asked, np.array([0]), np.array([block.bounds(asked)[0] + 1, 0]), 4)) == []
