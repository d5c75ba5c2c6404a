"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from riftstats.llm import simhash


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def slow_components(prints):
    ids, fps = list(prints), np.array(list(prints.values()), np.uint64)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 3):
            x, y = root(ids[a]), root(ids[b])
            if x != y:
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8)))
    out = [None, "", "  \n", "one", "One two", "ONE TWO", "é È Ünï\x0bx\x1cy"]
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(3, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = word()
            out.append("\t".join(base))
    base = [word() for _ in range(400)]
    for _ in range(60):  # one large group of near copies
        base[rng.randrange(400)] = word()
        out.append(" ".join(base))
    return out + ["same words here again"] * 40


@pytest.mark.parametrize("block", [64, 2])
def test_components(spark, block):
    rows = [(i * 3 % 1009, t, "x", 0) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(df, block=block).select("doc_id", "component_id", simhash.hexed().alias("h")).collect()}
    prints = {i: slow_fingerprint(t) for i, t, *_ in rows}
    assert {i: r.h for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(prints)


def test_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "zz yy xx ww vv"), (None, None)], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 5
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_parts(monkeypatch):
    t = " ".join(random.Random(1).choice(["ab", "cd", "e", "fgh"]) for _ in range(500))
    want = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "WORDS", 7)
    assert simhash.fingerprint(t) == want == slow_fingerprint(t)


def test_thresholds_fill_the_pigeonholes():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    for m in range(1, 5):
        parts = simhash.group_bits(np.eye(64), m)
        assert sorted(b for x in parts for b in x) == list(range(64))
        cost, ts = simhash.allot([simhash.estimated_cost(x, both, 1000, 3) for x in parts], 3 - m + 1)
        assert sum(ts) == 3 - m + 1 and cost > 0


def test_estimates_follow_correlated_bits(spark):
    """Against the counted pairs: where bits go together, and where they don't."""
    rng = np.random.default_rng(3)
    base = rng.random((600, 64)) < 0.5
    base[:, 1:16] = base[:, :1] ^ (rng.random((600, 15)) < 0.1)
    fps = np.packbits(base, axis=1, bitorder="little").view("<u8")[:, 0]
    n, both = simhash.bit_statistics(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3))
    assert n == 600 and np.allclose(both, base.T.astype(float) @ base / 600)
    for part in (list(range(16)), list(range(20, 36))):
        differ = (base[:, None, part] ^ base[None, :, part]).sum(axis=2)
        for t, share in enumerate(simhash.distance_shares(part, both, 3)):
            assert abs(share - (differ <= t).mean()) < 0.1
    together, apart = simhash.distance_shares(list(range(16)), both, 3)[2], simhash.distance_shares(list(range(20, 36)), both, 3)[2]
    assert together > 20 * apart


@pytest.mark.parametrize("sent", [10, 10**6])
def test_hubs(spark, sent):
    """A hub, chains and a ring; with few minima sent out and with all."""
    rng = random.Random(8)
    pairs = [(i, 5000) for i in range(300)] + [(6000 + i, 6001 + i) for i in range(40)] + [(7000 + i, 7000 + (i + 1) % 30) for i in range(30)] + [(9000 + rng.randrange(60), 9000 + rng.randrange(60)) for _ in range(50)]
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    up = {x: x for p in pairs for x in p}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "u long, v long").repartition(4), sent=sent).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
