"""SimHash fingerprints and their near duplicates by generalised pigeonhole.

Fingerprints that differ in at most `tau` bits agree within t_i bits on some
part i of the bits whenever the t_i of m parts sum to tau - m + 1 (t_i = -1
leaves part i out). The bits are grouped into parts by their correlation over
all fingerprints, and the thresholds are allotted by dynamic programming on the
candidate counts estimated from all fingerprints. Each distinct fingerprint is
entered once per part and probes the keys within t_i of its own; candidates are
verified on all 64 bits. Equal texts collapse to one fingerprint first, so a
group of copies of any size costs one entry. Keys that many different
fingerprints share are split into blocks, and each pair of blocks returns only
a spanning forest of its links, never all pairs.

Cases: a null, empty or blank text has fingerprint zero and links like any
other; repeated rows share a component; a row with a null id gets a fingerprint
and the component of its group, but is never a component's name unless all ids
of the group are null (then null); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, join_by_key, map_batches

BITS, TAU, SHINGLE, SEED = 64, 3, 3, 42
#: Distinct fingerprints of one key that are joined pairwise; larger keys are
#: cut into blocks of this size.
BLOCK = 64
#: Least neighbours of nodes that are sent to every executor at most.
SENT_ROWS = 100_000
#: Words handled at a time, so a text's length doesn't set the memory.
WORDS = 1 << 17


def votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of word shingles."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    for lo in range(0, len(words) - SHINGLE + 1, WORDS):
        part = words[lo : lo + WORDS + SHINGLE - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[: -SHINGLE].tolist()]
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        total += votes(np.array([digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64))
        count += len(stops)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id, key (the id if no other column is named) and fp (the fingerprint's
    bits as a long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(key_col or id_col).cast("long").alias("key"), text_col)
    return map_batches(own, run, "doc_id long, key long, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the frequency of each pair of set bits, over
    all of them. The tasks send 64 x 64 sums each, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            on = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += on.T @ on
            n += len(fp)
        i, j = np.triu_indices(BITS)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i * BITS + j, -1).astype(np.int32)), pa.array(np.append(both[i, j], n))], names=["at", "x"])

    sums = {r["at"]: r["x"] for r in prints.select("fp").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()}
    n = int(sums.pop(-1, 0))
    both = np.zeros((BITS, BITS))
    for at, x in sums.items():
        both[at // BITS, at % BITS] = both[at % BITS, at // BITS] = x / max(n, 1)
    return n, both


def correlation_of(both: np.ndarray) -> np.ndarray:
    """Absolute correlation of the bits."""
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of equal width; each grows by the free bit that is most
    correlated with the bits it has."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        inner = sorted(free)
        first = max(inner, key=lambda b: (correlation[b, inner].sum(), -b))
        part = [first]
        free.remove(first)
        while len(part) < width:
            best = max(sorted(free), key=lambda b: (correlation[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def distance_shares(part: list[int], both: np.ndarray, tau: int) -> list[float]:
    """Shares of pairs of fingerprints that differ in 0..t bits of a part, for
    t = 0..tau. The mean and the variance of the number of differing bits follow
    from the pair frequencies of all fingerprints, whatever the correlation of
    the bits; a beta-binomial law has both."""
    at = np.ix_(part, part)
    p, w = np.diag(both)[part], len(part)
    p11 = both[at]
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    joint = 2 * (p11 * (1 - p11 - p10 - p01) + p10 * p01)  # both bits differ
    differ = 2 * p * (1 - p)
    np.fill_diagonal(joint, differ)
    mean = float(differ.sum())
    variance = float((joint - np.outer(differ, differ)).sum())
    rate = min(max(mean / w, 1e-9), 1 - 1e-9)
    spread = (variance / (w * rate * (1 - rate)) - 1) / max(1, w - 1)
    spread = min(max(spread, 1e-6), 1 - 1e-6)
    a, b = rate * (1 / spread - 1), (1 - rate) * (1 / spread - 1)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    share = [math.comb(w, k) * math.exp(beta(k + a, w - k + b) - beta(a, b)) if k <= w else 0.0 for k in range(tau + 1)]
    return [min(1.0, x) for x in np.cumsum(share).tolist()]


def estimated_cost(part: list[int], both: np.ndarray, n: int, tau: int) -> list[float]:
    """Probes and expected candidates of all queries for thresholds -1..tau."""
    near = distance_shares(part, both, tau)
    return [0.0] + [n * sum(math.comb(len(part), d) for d in range(t + 1)) + n * float(n) * near[t] for t in range(tau + 1)]


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 at least) of the parts that sum to `total` at least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, len(cost) - 1):
                now = (c + cost[t + 1], [*ts, t])
                if used + t not in step or now[0] < step[used + t][0]:
                    step[used + t] = now
        best = step
    return best[total]


def plan(prints: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed."""
    n, both = bit_statistics(prints)
    correlation, found = correlation_of(both), None
    for m in range(tau + 1, 0, -1):  # the most parts, hence the fewest probes, where costs tie
        parts = group_bits(correlation, m)
        cost, ts = allot([estimated_cost(x, both, n, tau) for x in parts], tau - m + 1)
        if found is None or cost < found[0]:
            found = (cost, [(x, t) for x, t in zip(parts, ts, strict=True) if t >= 0])
    return found[1]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def candidate_keys(prints: DataFrame, parts: list[tuple[list[int], int]]) -> tuple[DataFrame, DataFrame]:
    """(part, key, node, fp) of the entries, and of the probes of all keys
    within the part's threshold."""
    own, near = [], []
    for i, (bits, t) in enumerate(parts):
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        own.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        flips = [_mask(c) for d in range(t + 1) for c in combinations(bits, d)]
        near.append(F.array(*[F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(x)).alias("key")) for x in flips]))
    out = []
    for keys in (F.array(*own), F.concat(*near)):
        out.append(prints.select("node", "fp", F.explode(keys).alias("k")).select("k.part", "k.key", "node", "fp"))
    return out[0], out[1]


def forest(fps_a: np.ndarray, fps_b: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links within tau between two blocks, thinned to a spanning forest."""
    ids = {x: i for i, x in enumerate(dict.fromkeys([*nodes_a.tolist(), *nodes_b.tolist()]))}
    up = list(range(len(ids)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    fps_a, fps_b = fps_a.view(np.uint64), fps_b.view(np.uint64)  # bits of signed numbers are counted by their magnitude
    for i, fp in enumerate(fps_a):
        for j in np.flatnonzero(np.bitwise_count(fps_b ^ fp) <= tau).tolist():
            a, b = int(nodes_a[i]), int(nodes_b[j])
            x, y = root(ids[a]), root(ids[b])
            if x != y:
                up[x] = y
                out.append((max(a, b), min(a, b)))
    return out


def links(prints: DataFrame, parts: list[tuple[list[int], int]], tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """(u, v) with u > v: enough links between distinct fingerprints to have the
    same components as all links."""
    entries, probes = candidate_keys(prints, parts)
    sizes = entries.groupBy("part", "key").agg(F.count("*").alias("n"))
    shared = probes.groupBy("part", "key").agg(F.count("*").alias("n_probe")).where("n_probe > 1").join(sizes, ["part", "key"])
    # a key is cold if both its entries and its probes are few
    large = shared.where((F.col("n") > block) | (F.col("n_probe") > 8 * block)).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("probe_blocks", F.ceil(F.col("n_probe") / block).cast("int")).select("part", "key", "blocks", "probe_blocks")
    large = cut(large)
    differ = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    if large.isEmpty():
        cold_a, cold_b = entries, probes
    else:
        cold_a, cold_b = entries.join(large, ["part", "key"], "left_anti"), probes.join(large, ["part", "key"], "left_anti")
    cold = (
        cold_a.alias("a").join(cold_b.alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (differ <= tau))
        .select(F.col("b.node").alias("u"), F.col("a.node").alias("v"))
    )
    if large.isEmpty():
        return cold.distinct()
    hashed = F.abs(F.xxhash64("node"))
    a = entries.join(large, ["part", "key"]).withColumn("i", (hashed % F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1)))
    b = probes.join(large, ["part", "key"]).withColumn("j", (hashed % F.col("probe_blocks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = a.select("part", "key", "i", "j", "node", "fp", F.lit(0).alias("side")).unionByName(b.select("part", "key", "i", "j", "node", "fp", F.lit(1).alias("side")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solve(t: pa.Table) -> list[tuple[int, int]]:
            key = np.stack([t[c].to_numpy() for c in ("part", "key", "i", "j")], axis=1)
            side, node, fp = (np.ascontiguousarray(t[c].to_numpy()) for c in ("side", "node", "fp"))
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(side)], strict=True):
                mid = lo + int((side[lo:hi] == 0).sum())
                out += forest(fp[lo:mid], fp[mid:hi], node[lo:mid], node[mid:hi], tau)
            return out

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["u", "v"])

        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            key = np.stack([t[c].to_numpy() for c in ("part", "key", "i", "j")], axis=1)
            change = np.flatnonzero((key != key[-1]).any(axis=1))
            at = int(change[-1]) + 1 if len(change) else 0  # the last unit may go on
            if at:
                yield made(solve(t.slice(0, at)))
            held = t.slice(at)
        if held is not None and held.num_rows:
            yield made(solve(held))

    dealt = units.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", "side")
    return cold.unionByName(dealt.mapInArrow(run, "u long, v long")).distinct()


def with_least(rows: DataFrame, n: int, sent: int = SENT_ROWS) -> DataFrame:
    """rows (u, v, ...) with m, the least v of the same u. n: number of rows at
    most. Where that is few, all minima are sent out; beyond it those of the u
    with the most rows, which are at most `sent` in number, so that no u has more
    than 2 n / sent rows in the task of the shuffled rest."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    if n <= sent:
        return rows.join(F.broadcast(least.select("u", "m")), "u")
    most = -(-n // sent)
    hubs = F.broadcast(least.where(F.col("degree") > most).select("u", "m"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("degree") <= most).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(rest)


def components(edges: DataFrame, most: int = 60, sent: int = SENT_ROWS) -> DataFrame:
    """(node, root) of every node that has a link: the least node that it
    reaches. Alternates large-star and small-star steps until nothing changes."""
    edges = cut(edges.select("u", "v"))
    n, state = edges.count(), None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * n, sent).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        if n > sent:  # with_least reads its rows more than once then
            large = cut(large)
        small = with_least(large, n, sent)
        edges = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        edges = cut(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        n, state = now[0], now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(each: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """fp, root, component_id and number of rows `n` of every distinct fingerprint of
    `each`."""
    prints = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    # rows whose ids are all null need a node of their own: the fingerprint stands in
    root = components(links(prints.select("fp", F.col("fp").alias("node")), plan(prints, tau), tau, block))
    group = cut(prints.join(root, prints.fp == root.node, "left").select(F.coalesce("root", "fp").alias("u"), F.col("least").alias("v"), "fp", "n"))
    return with_least(group, group.count()).select("fp", F.col("u").alias("root"), F.col("m").alias("component_id"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    each = cut(fingerprints(docs, id_col, text_col))
    return join_by_key(each, cut(grouped(each, tau, block).drop("root")), "fp", "n").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """(key) of one row of each component: that of the smallest id, then of the
    smallest key; of a component without ids the smallest key."""
    each = cut(fingerprints(docs, id_col, text_col, key_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    prints = each.groupBy("fp").agg(first.alias("first"))
    return prints.join(grouped(each, tau, block), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.key")


def hexed(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
