"""Nearest neighbours by multiprobe p-stable hashing, largest cosine first.

Vectors are scaled to length one, where Euclidean distance orders as the cosine
does. A table hashes a vector to the cells of HASHES random projections of width
WIDTH. A query visits, in each of TABLES tables, its own bucket and the buckets
of the PROBES - 1 likeliest perturbations, in the order of their estimated
success (the squared distances to the cell borders, smallest first). Candidates
of all tables are reranked by the exact cosine in double precision.

Unless they are given, TABLES, HASHES, WIDTH and PROBES come from the data: the
true neighbours of TUNED_QUERIES queries (by hash of their id) are found among all
vectors in one pass, and the settings of a grid are played through on them and on
TUNED_OTHERS other vectors. Of those that find TUNED_RECALL of the neighbours the
one with the least expected work for the table's size is taken: near duplicates
need many hashes and few probes, vectors without neighbours few hashes and many
probes. With the table the grid's deepest settings become the cheapest.

The work of a bucket is cut into units of at most BLOCK candidates and BLOCK
queries, so one bucket never sets the size of a task, and a unit passes on no
more than the best of each query. Equal vectors are collapsed first: of each
group only the k + 1 smallest ids can be among k neighbours, and equal queries
are searched once.

Cases: vectors that are null, zero or hold a null or non-finite component take
no part; a query with no other vector has no row; with fewer than k candidates
found a query has fewer rows; ties go to the smaller vec_id; null ids take no
part; repeated ids are separate candidates (equal ids are not a query's own
neighbours); vectors of a length other than the query's are never its
candidates; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checked_side, cut, map_batches

SEED = 11
#: The grid of settings, and the sample that they are tried on.
TABLE_COUNTS, HASH_COUNTS, WIDTHS = (2, 4, 6), (2, 3, 4, 5, 6), (0.6, 1.0, 1.5)
TUNED_QUERIES, TUNED_OTHERS, TUNED_RECALL = 64, 1000, 0.96
#: Work of a visit of a bucket, in reranked candidates.
VISIT_WORK = 20
BLOCK = 512
#: Found pairs that a task holds before it drops all but the best of a query.
HELD = 200_000


def projections(dim: int, table: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    return rng.normal(size=(dim, hashes)), rng.uniform(0, width, hashes)


def perturbations(frac: np.ndarray, n: int) -> list[np.ndarray]:
    """The n likeliest cell offsets of a point at `frac` (0..1) of its cell."""
    k = len(frac)
    moves = sorted([(float(x * x), i, -1) for i, x in enumerate(frac)] + [(float((1 - x) ** 2), i, 1) for i, x in enumerate(frac)])
    out, heap = [np.zeros(k, np.int64)], [(moves[0][0], (0,))]
    while heap and len(out) < n:
        score, chosen = heapq.heappop(heap)
        if len({moves[j][1] for j in chosen}) == len(chosen):
            offset = np.zeros(k, np.int64)
            for j in chosen:
                offset[moves[j][1]] = moves[j][2]
            out.append(offset)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (score - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + moves[last + 1][0], (*chosen, last + 1)))
    return out


def bucket_of(cells: np.ndarray) -> np.ndarray:
    """Rows of cell numbers to one long each."""
    h = np.zeros(len(cells), np.uint64)
    for c in cells.T:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & some)


def hashed(rows: DataFrame, probes: int, tables: int, hashes: int, width: float) -> DataFrame:
    """(id, v, dim, tab, bucket): of each row its own bucket in each table
    (probes = 1), or all that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            flat, ends = b.column(1).flatten().to_numpy(), np.cumsum(n)
            for dim in np.unique(n).tolist():
                own = np.flatnonzero(n == dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                for t in range(tables):
                    a, shift = projections(dim, t, hashes, width)
                    at = (x @ a + shift) / width
                    cell = np.floor(at).astype(np.int64)
                    if probes == 1:
                        row, bucket = own, bucket_of(cell)
                    else:
                        visits = [cell[i] + d for i in range(len(own)) for d in perturbations(at[i] - cell[i], probes)]
                        row, bucket = np.repeat(own, len(visits) // len(own)), bucket_of(np.stack(visits))
                    for lo in range(0, len(row), 4096):
                        at_rows, k = pa.array(row[lo : lo + 4096]), len(row[lo : lo + 4096])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(at_rows), b.column(1).take(at_rows), pa.array(np.full(k, dim, np.int32)), pa.array(np.full(k, t, np.int32)), pa.array(bucket[lo : lo + 4096])], names=["id", "v", "dim", "tab", "bucket"])

    return map_batches(rows.select("id", "v"), run, "id long, v array<double>, dim int, tab int, bucket long")


class Setting(NamedTuple):
    tables: int
    hashes: int
    width: float
    probes: int


#: For tables with nothing to tune on.
PLAIN = Setting(4, 4, 1.3, 72)
#: For tables that no setting of the grid serves: cells so wide that one holds all
#: vectors, and all of its neighbours are visited, so that nothing is missed.
WHOLE = Setting(1, 1, 1e6, 3)


def unit_rows(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def visit_ranks(at: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The number of visits of a query (its position in cells, `at`) before that of
    each of `cells`; more than 3 to the hashes where it never comes."""
    own = np.floor(at)
    frac = at - own
    k = len(at)
    steps = np.stack(np.meshgrid(*[np.array([0, -1, 1])] * k, indexing="ij"), axis=-1).reshape(-1, k)
    cost = np.where(steps < 0, frac**2, np.where(steps > 0, (1 - frac) ** 2, 0.0)).sum(axis=1)
    delta = cells - own
    near = np.abs(delta).max(axis=1) <= 1
    price = np.where(delta < 0, frac**2, np.where(delta > 0, (1 - frac) ** 2, 0.0)).sum(axis=1)
    return np.where(near, np.searchsorted(np.sort(cost), price - 1e-12), 3**k + 1)


def tuned(index: DataFrame, queries: DataFrame, k: int) -> Setting:
    """The cheapest setting of the grid that finds enough of the true neighbours of
    the sampled queries; if none does, the one that looks at every vector."""
    place = F.xxhash64("id")
    sample = queries.withColumn("dim", F.size("v")).orderBy(place, "id").limit(TUNED_QUERIES).collect()
    if not sample:
        return PLAIN
    dim = Counter(r["dim"] for r in sample).most_common(1)[0][0]
    asked = [(r["id"], list(r["v"])) for r in sample if r["dim"] == dim]
    same = index.where(F.size("v") == dim)
    n = same.count()
    others = [list(r["v"]) for r in same.where(F.pmod(place, F.lit(1 << 20)) < max(1, int(2 * TUNED_OTHERS / max(n, 1) * (1 << 20)))).limit(TUNED_OTHERS).select("v").collect()]
    sent = index.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked]), unit_rows([v for _, v in asked])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
            near = np.where(ids[:, None] == b.column(0).to_numpy()[None, :], -2.0, q @ x.T)
            best = np.argsort(-near, axis=1)[:, :k]
            row = np.repeat(np.arange(len(ids)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(near[row, best.ravel()]), b.column(1).take(pa.array(best.ravel()))], names=["q", "near", "v"])

    best = map_batches(same.select("id", "v"), run, "q int, near double, v array<double>").where("near > -2")
    # k rows a query and batch; Spark keeps the k best of each query
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near")))).where(F.col("n") <= k).collect()
    if not first or not others:
        return PLAIN
    q, pool = sent.value[1], unit_rows(others)
    true, whose = unit_rows([list(r["v"]) for r in first]), np.array([r["q"] for r in first])
    found: list[tuple[float, float, Setting]] = []
    for hashes in HASH_COUNTS:
        for width in WIDTHS:
            hit, work = [], []
            for t in range(max(TABLE_COUNTS)):
                a, shift = projections(dim, t, hashes, width)
                at, near, far = (q @ a + shift) / width, np.floor((true @ a + shift) / width), np.floor((pool @ a + shift) / width)
                rank = np.zeros(len(true))
                for i in range(len(q)):
                    rank[whose == i] = visit_ranks(at[i], near[whose == i]) if (whose == i).any() else 0
                hit.append(rank)
                work.append(np.concatenate([visit_ranks(at[i], far) for i in range(0, len(q), 2)]))  # half of them will do
            for tables in TABLE_COUNTS:
                least, all_work = np.min(hit[:tables], axis=0), np.sort(np.concatenate(work[:tables]))
                for probes in sorted({min(p, 3**hashes) for p in (1, 2, 4, 8, 16, 27, 48, 81, 120, 180, 243)}):
                    reranked = np.searchsorted(all_work, probes) / len(range(0, len(q), 2)) / len(pool) * n
                    found.append((float((least < probes).mean()), reranked + VISIT_WORK * tables * probes, Setting(tables, hashes, width, probes)))
    good = [f for f in found if f[0] >= TUNED_RECALL]
    return min(good, key=lambda f: (f[1], f[2]))[2] if good else WHOLE


def units(index: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """Both sides dealt to (dim, tab, bucket, i, j): candidates to block i of
    their bucket and all blocks j of queries, and the other way round."""
    key = ["dim", "tab", "bucket"]
    sizes = index.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("ni")).join(queries.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("nj")), key)
    sizes = checked_side(sizes)  # a bucket with a large part of the rows isn't dealt to one task where the sizes are few
    spread = F.abs(F.xxhash64("id"))
    a = index.join(sizes, key).withColumn("i", (spread % F.col("ni")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("side", F.lit(1))
    b = queries.join(sizes, key).withColumn("j", (spread % F.col("nj")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("side", F.lit(0))
    cols = [*key, "i", "j", "side", "id", "v"]
    return a.select(*cols).unionByName(b.select(*cols))


def best_of(pairs: DataFrame, keep: int) -> DataFrame:
    """(query, id, score): the `keep` best candidates of each query in a task."""
    key = ["dim", "tab", "bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(t: pa.Table) -> None:
            side = t["side"].to_numpy()
            n = int((side == 0).sum())
            if not n or n == len(side):
                return
            x = t["v"].combine_chunks().flatten().to_numpy().reshape(len(side), -1)
            ids = t["id"].to_numpy()
            norm = np.sqrt((x * x).sum(axis=1))
            unit = x / norm[:, None]
            near = unit[:n] @ unit[n:].T
            m = near.shape[1]
            least = np.partition(near, m - keep, axis=1)[:, m - keep, None] if m > keep else -2.0
            r, c = np.nonzero(near >= least - 1e-9)  # exact scores decide among these
            best.append((ids[r], ids[n + c], (x[n + c] * x[r]).sum(axis=1) / (norm[n + c] * norm[r])))

        def compact() -> None:
            q, i, s = (np.concatenate(a) for a in zip(*best, strict=True))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            fresh = np.ones(len(q), bool)
            fresh[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])  # a pair that several buckets found
            q, i, s = q[fresh], i[fresh], s[fresh]
            first = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            best[:] = [(q[place < keep], i[place < keep], s[place < keep])]

        def emit() -> Iterator[pa.RecordBatch]:
            if best:
                compact()
                for lo in range(0, len(best[0][0]), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 8192]) for a in best[0]], names=["query", "id", "score"])
                best.clear()

        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            k = np.stack([t[c].to_numpy() for c in key], axis=1)
            cuts = (np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], cuts, strict=False):
                solve(t.slice(lo, hi - lo))
            held = t.slice(cuts[-1] if cuts else 0)
            if sum(len(x[0]) for x in best) > HELD:
                compact()
                if len(best[0][0]) > HELD // 2:
                    yield from emit()
        if held is not None and held.num_rows:
            solve(held)
        yield from emit()

    return pairs.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, "query long, id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", setting: Setting | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, a row
    with the query's own id excepted. Queries are rows like those of vectors.
    Settings are tuned to the data if none are given."""
    same = Window.partitionBy("v").orderBy("id")
    index = valid(vectors, id_col, vec_col).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "v")
    asked = valid(queries, id_col, vec_col)
    once = asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    index = cut(index)
    tables, hashes, width, probes = setting or tuned(index, once, k)
    found = best_of(units(hashed(index, 1, tables, hashes, width), hashed(once, probes, tables, hashes, width), block), k + 1)
    merged = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = merged.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("n", "id", "score")).alias("found"))
    whose = asked.join(once.withColumnRenamed("id", "query"), "v").select(F.col("id").alias("query_id"), "query")
    own = F.slice(F.filter(F.array_sort("found"), lambda x: x["id"] != F.col("query_id")), 1, k)
    return whose.join(top, "query").select("query_id", F.posexplode(own)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.score").alias("score"))
