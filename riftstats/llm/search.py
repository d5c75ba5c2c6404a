"""Ranked lexical search over a length-stratified index.

Documents of equal length normaliser m form a stratum; a stratum is kept in
blocks of at most BLOCK_DOCS documents, so that one common length is no hot key.
A block holds, for every term and every tf of it, the list of its documents with
that tf, highest tf first; all documents of such a list have the same impact,
which is computed once. The score grows with tf and falls with m, so a term's
first list bounds it.

Per lot of items (LOT_TERMS bounds what is sent to the executors):

1. every document is split once; its terms that some item asks for, with their
   tf, go to the shared folder, as do the blocks made from them;
2. each item visits the stratum of its highest bound, which gives a lower bound
   of its k-th best score;
3. all blocks are read; in a task they are visited in the order of their bounds,
   an item skips the blocks whose bound is below its k-th best score so far, and
   each block gives at most k documents an item. A window takes the k best.

Nothing is dropped by the bounds: an equal bound is still visited, since a
smaller id wins a tie.

Cases: null and empty texts and those of separators only have no terms, are
found by no item and don't count in N; an item without terms has no result; the
rows of an item_id are one item with the terms of all of them; repeated documents
are ranked one by one (equal scores and ids in any order, a null id last); a text of
any length is split whole; empty tables give an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import checked_side, cut, map_batches, written

#: Distinct terms of items that are sent to the executors together; documents in
#: a block; cells of the dense impacts that a block is scored with at once.
LOT_TERMS, BLOCK_DOCS, CELLS = 1_000_000, 256, 4_000_000
#: Fixed values of the score.
SCALE, LENGTH_SHARE, LENGTH_BASE, LENGTH_WEIGHT = 1_000_000_000, 90, 100, 8

#: Letters A-Z to a-z; ASCII that is neither letter nor digit separates terms.
#: All bytes of other characters are above 0x7F, so this works on UTF-8.
FOLD = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def impact(tf, m):  # noqa: ANN001, ANN201
    return (SCALE * tf) // (1000 * tf + LENGTH_WEIGHT * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Asked:
    """The items of a lot: their ids, and one entry of each item and term, in the
    order of items."""

    ids: list[int | None]
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    starts: np.ndarray
    least: np.ndarray  # a score that the item's k-th best document has at least


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, terms = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = sorted(set(terms_of(t or b"")))
                ids += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())], names=["item_id", "term"])

    return map_batches(items.select(F.col(id_col).cast("long"), text_col), run, "item_id long, term string").distinct()


def counted(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n and, of the vocabulary's terms, terms and tfs of every
    document with a term, in the shared folder."""
    number = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = number.value.get, TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rows, lengths, terms, tfs, ends = [], [], [], [], [], [0]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms_of(t or b"")
                row += 1
                if not words:
                    continue
                own = Counter(map(get, words))
                own.pop(None, None)
                ids.append(i)
                rows.append(row)
                lengths.append(len(words))
                terms += own.keys()
                tfs += own.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], names=["row", "doc_id", "n", "terms", "tfs"])

    return written(map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, "row long, doc_id long, n long, terms array<int>, tfs array<int>"), "search-documents")


def index(documents: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The blocks of all strata in the shared folder: m, docs and, for each list of
    a term and tf, term, tf and the end of the list in posts, which holds places
    in docs. documents: as counted() returns them."""
    m = F.expr(f"{LENGTH_BASE - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {n_docs}L) div {n_terms}L")
    rows = documents.where(F.size("terms") > 0).withColumn("m", m)
    shards = checked_side(rows.groupBy("m").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("shards")))
    dealt = rows.join(shards, "m").withColumn("shard", F.pmod(F.xxhash64("row"), "shards"))
    blocks = dealt.groupBy("m", "shard").agg(F.collect_list(F.struct("doc_id", "terms", "tfs")).alias("d"))
    blocks = blocks.select("m", F.col("d.doc_id").alias("docs"), F.transform("d.terms", F.size).alias("sizes"), F.flatten("d.terms").alias("terms"), F.flatten("d.tfs").alias("tfs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m, docs, sizes, terms, tfs = (b.column(c)[i] for c in range(5))
                term, tf = (np.asarray(x.values, np.int32) for x in (terms, tfs))
                sizes = np.asarray(sizes.values, np.int32)
                order = np.lexsort((-tf, term))
                term, tf, post = term[order], tf[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
                ends = np.flatnonzero(np.concatenate(((np.diff(term) != 0) | (np.diff(tf) != 0), [True]))) + 1
                lists = [pa.array([x], pa.list_(pa.int32())) for x in (term[ends - 1], tf[ends - 1], ends.astype(np.int32), post)]
                yield pa.RecordBatch.from_arrays([pa.array([m.as_py()], pa.int64()), pa.array([docs.as_py()], pa.list_(pa.int64())), *lists], names=["m", "docs", "term", "tf", "ends", "posts"])

    return written(map_batches(blocks, run, "m long, docs array<long>, term array<int>, tf array<int>, ends array<int>, posts array<int>"), "search-index")


class Block:
    """A block's impacts, ready to be scored."""

    def __init__(self, m: int, docs: list[int | None], term: np.ndarray, tf: np.ndarray, ends: np.ndarray, posts: np.ndarray):
        self.docs, self.posts = docs, posts
        self.counts = np.diff(ends, prepend=0)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.terms, self.row = term[first], np.cumsum(np.diff(term, prepend=-1) != 0) - 1
        self.impacts = impact(tf.astype(np.int64), m).astype(np.float64)  # one a list
        self.most = self.impacts[first]

    def places(self, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
        """Place of each asked term among the block's terms, and whether it is there."""
        at = np.minimum(np.searchsorted(self.terms, asked.term), len(self.terms) - 1)
        return at, self.terms[at] == asked.term

    def bounds(self, asked: Asked) -> np.ndarray:
        at, there = self.places(asked)
        return np.bincount(asked.item[there], weights=asked.weight[there] * self.most[at[there]], minlength=len(asked.ids))

    def best(self, asked: Asked, visited: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, int, int | None]]:
        """(item, score, doc_id) of at most k documents of each visited item with at
        least its least score."""
        at, there = self.places(asked)
        step = max(1, CELLS // len(self.terms))
        row, value = np.repeat(self.row, self.counts), np.repeat(self.impacts, self.counts)
        for lo in range(0, len(self.docs), step):
            near = (self.posts >= lo) & (self.posts < lo + step)
            dense = np.zeros((len(self.terms), min(step, len(self.docs) - lo)))
            dense[row[near], self.posts[near] - lo] = value[near]
            for i in visited.tolist():
                own = slice(asked.starts[i], asked.starts[i + 1])
                got = asked.weight[own][there[own]] @ dense[at[own][there[own]]]  # whole numbers below 2^53, so exact
                found = np.flatnonzero(got >= max(1, least[i]))
                if len(found) > k:
                    found = found[got[found] >= np.partition(got[found], -k)[-k]]
                ranked = sorted((-int(got[j]), self.docs[lo + j] is None, self.docs[lo + j] or 0) for j in found.tolist())
                for score, missing, doc in ranked[:k]:
                    yield i, -score, None if missing else doc


def hits(blocks: DataFrame, asked: Asked, k: int, only: str | None = None) -> DataFrame:
    """item (its number), score and doc_id of the best documents of each block, no
    less than k an item that are among the best k of all. only: a column with the
    numbers of the items that visit the block; without it the bounds decide."""
    lot = blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = lot.value
        least = asked.least.copy()
        top: dict[int, list[int]] = {}
        for b in batches:
            read = [Block(b.column(0)[i].as_py(), b.column(1)[i].as_py(), *(np.asarray(b.column(c)[i].values, np.int32) for c in range(2, 6))) for i in range(b.num_rows)]
            bounds = [block.bounds(asked) for block in read]
            order = sorted(range(len(read)), key=lambda i: -bounds[i].sum())
            item, score, doc = [], [], []
            for j in order:
                visited = np.flatnonzero((bounds[j] >= least) & (bounds[j] > 0)) if only is None else np.array(b.column(6)[j].as_py(), np.int64)
                for i, s, d in read[j].best(asked, visited, least, k):
                    item.append(i)
                    score.append(s)
                    doc.append(d)
                    own = top.setdefault(i, [])
                    own.append(s)
                    if len(own) >= 2 * k:
                        own.sort(reverse=True)
                        del own[k:]
                        least[i] = max(least[i], own[-1])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64())], names=["item", "score", "doc_id"])

    cols = ["m", "docs", "term", "tf", "ends", "posts", *([only] if only else [])]
    return map_batches(blocks.select(*cols), run, "item int, score long, doc_id long")


def placed(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_visits(blocks: DataFrame, asked: Asked) -> DataFrame:
    """m, items: the stratum of each item's highest bound."""
    spark = blocks.sparkSession
    most = blocks.select("m", F.explode(F.arrays_zip("term", "tf")).alias("p")).groupBy("m", F.col("p.term").alias("term")).agg(F.max("p.tf").cast("long").alias("tf"))
    rows = pa.table({"item": asked.item.astype(np.int32), "term": asked.term.astype(np.int32), "w": asked.weight.astype(np.int64)})
    bound = F.sum(F.expr(f"w * (({SCALE} * tf) div (1000 * tf + {LENGTH_WEIGHT} * m))")).alias("bound")
    bounds = most.join(F.broadcast(spark.createDataFrame(rows)), "term").groupBy("item", "m").agg(bound)
    best = bounds.groupBy("item").agg(F.max_by("m", F.struct("bound", -F.col("m"))).alias("m"))
    return best.groupBy("m").agg(F.collect_list("item").alias("items"))


def search_lot(docs: DataFrame, rows: list[tuple[int | None, str]], k: int) -> DataFrame:
    """item_id, rank, doc_id and score for the items of one lot, given as pairs of
    item and term."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, t in rows})
    documents = counted(docs, vocabulary)
    n_docs, n_terms = documents.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = index(documents, n_docs, max(1, n_terms))
    df = np.zeros(len(vocabulary), np.int64)
    for r in documents.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the lot's terms at most
        df[r.t] = r["count"]
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i or 0))
    place = {i: n for n, i in enumerate(ids)}
    pairs = sorted((place[i], number[t]) for i, t in rows)
    item, term = (np.array([p[c] for p in pairs], np.int64) for c in (0, 1))
    weights = np.array([weight(n_docs, x) for x in df.tolist()], np.float64)[term]
    asked = Asked(ids, item, term, weights, np.searchsorted(item, np.arange(len(ids) + 1)), np.zeros(len(ids)))

    visits = checked_side(first_visits(blocks, asked))
    kth = placed(hits(blocks.join(visits, "m"), asked, k, "items"), k).where(F.col("rank") == k).select("item", "score")
    for r in kth.collect():  # one number an item of the lot
        asked.least[r.item] = r.score
    best = placed(hits(blocks, asked, k), k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents."""
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    terms = cut(item_terms(items, item_col, item_text))
    lots = math.ceil(terms.count() / LOT_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for lot in range(lots):
        rows = [(r.item_id, r.term) for r in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(lots)) == lot).collect()]  # about LOT_TERMS
        if rows:
            out = out.unionByName(search_lot(own, rows, k))
    return out
