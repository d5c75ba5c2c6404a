"""Benchmark decontamination with a BM25 index and block-max WAND.

The test items are the indexed texts, the passages of every document the
queries. A posting holds an item's BM25 weight for a term divided by the item's
score against itself, so one threshold fits items of all lengths. Postings are
cut into blocks of items with each block's largest weight. For each passage the
terms are put in order of their largest weights; those whose weights together
stay below the threshold can't make a hit, so only the blocks of the others, from
the pivot on, are visited. A block is left as soon as its bounds, with what the
skipped terms can add at most, stay below the threshold; then the skipped terms'
own bounds for the block are added, and only what still reaches the threshold is
scored exactly. Every item at or above the threshold is then verified: the
five-word shingles of its question (first two thirds of its words) and of its
answer (the rest) must both occur in the document around the passage.

The index is built by Spark and sent out in shards of at most some SHARD_WORDS
postings, whatever the size of the benchmark, one after another; every passage
meets every shard. Passages are taken in lots of CELLS block bounds at most, so
neither the benchmark nor a long document sets the memory of a task.

Cases: null or empty texts and items give no rows; items of fewer than five
words are verified by their whole word sequence; items are known by id and words,
so repeated items give one row each document, items of one id with different
words a row each, and those without an id rows with a null item_id; repeated
documents give repeated rows; documents of any length are searched whole, in
passages; an empty table gives an empty result; a null doc_id is carried as null;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, map_batches

#: BM25 constants, share of an item's own score that a passage must reach, share
#: of question and of answer shingles that must be found.
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.5
SHINGLE = 5
#: Items in a block; postings in a shard, which bounds what is sent out.
BLOCK_ITEMS, SHARD_WORDS = 32, 2_000_000
#: Bounds of (passage, block) held at a time; cells of the table of entries by
#: term and block that is held instead of searching for them.
CELLS, TABLE_CELLS = 1 << 20, 1 << 23
#: Least words in a passage; it is twice the longest item if that is more.
PASSAGE = 128
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def tokenised(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, item_id and words of every distinct item, by the same rule as the passages."""

    @F.pandas_udf("array<string>")
    def split(text):  # noqa: ANN001, ANN202
        return text.map(words_of)

    rows = items.select(F.col(id_col).cast("long").alias("id"), split(text_col).alias("words")).where(F.size("words") > 0)
    return rows.select(F.xxhash64("id", "words").alias("item_id"), "id", "words").dropDuplicates(["item_id"])


def postings(items: DataFrame) -> DataFrame:
    """term, item_id, weight: BM25 over the item's own score."""
    size = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    each = items.select("item_id", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = each.join(df, "term").crossJoin(F.broadcast(size)).withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    own = scored.groupBy("item_id").agg(F.sum("w").alias("own"))
    return scored.join(own, "item_id").select("term", "item_id", (F.col("w") / F.col("own")).alias("w"))


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges lo..hi one after another, and each range's length."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), n


class Index:
    """One shard: postings by term, in blocks of BLOCK_ITEMS items. Made on the
    driver from the arrays of its postings; workers unpickle it once."""

    def __init__(self, term: list[str], item: np.ndarray, weight: np.ndarray, texts: dict[int, list[str]], passage: int):
        self.items = sorted(texts)
        self.words = [texts[x] for x in self.items]
        self.term = {t: i for i, t in enumerate(dict.fromkeys(term))}
        terms = np.fromiter(map(self.term.__getitem__, term), np.int64, len(term))
        items = np.searchsorted(np.array(self.items, np.int64), np.asarray(item, np.int64))
        order = np.lexsort((items, terms))
        terms, self.item, self.weight = terms[order], items[order], np.asarray(weight, np.float64)[order]
        self.n_blocks = -(-len(self.items) // BLOCK_ITEMS)
        key = terms * self.n_blocks + self.item // BLOCK_ITEMS
        self.first = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))  # postings of an entry (term, block)
        self.entry = key[self.first[:-1]]
        self.block = self.entry % self.n_blocks
        self.most = np.maximum.reduceat(self.weight, self.first[:-1])
        self.first_entry = np.searchsorted(self.entry // self.n_blocks, np.arange(len(self.term) + 1))
        self.term_most = np.maximum.reduceat(self.most, self.first_entry[:-1])
        self.table = None
        if len(self.term) * self.n_blocks <= TABLE_CELLS:
            self.table = np.full(len(self.term) * self.n_blocks, -1, np.int32)
            self.table[self.entry] = np.arange(len(self.entry))
        self.passage = passage

    def entry_of(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Numbers of the entries of (term, block), -1 where there is none."""
        key = term * self.n_blocks + block
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        return np.where(self.entry[at] == key, at, -1)

    @lru_cache(maxsize=4096)  # noqa: B019
    def parts(self, i: int) -> tuple[set[str], set[str], int]:
        """Shingles of an item's question and answer, and its length."""
        w = self.words[i]
        cut = max(1, len(w) * 2 // 3)
        return self.shingles(w[:cut]), self.shingles(w[cut:]) or self.shingles(w), len(w)

    @staticmethod
    def shingles(w: list[str]) -> set[str]:
        if not w:
            return set()
        n = min(SHINGLE, len(w))
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    def scored(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item's number, score) of the items at or above the threshold,
        for the terms of some passages, in order of passage."""
        if not len(passage):
            return []
        base, nb = int(passage[0]), self.n_blocks
        most = self.term_most[term]
        order = np.lexsort((most, passage))
        passage, term, most = passage[order] - base, term[order], most[order]
        n = int(passage[-1]) + 1
        begin = np.searchsorted(passage, np.arange(n + 1))
        total = np.concatenate(([0.0], np.cumsum(most)))
        so_far = total[1:] - total[begin[passage]]
        skipped = so_far < THRESHOLD - 1e-9
        could_add = np.bincount(passage[skipped], most[skipped], minlength=n)
        # bounds of the blocks that a term from the pivot on stands in
        some = ~skipped
        at, count = spread(self.first_entry[term[some]], self.first_entry[term[some] + 1])
        bound = np.bincount(np.repeat(passage[some], count) * nb + self.block[at], self.most[at], minlength=n * nb)
        cell = np.flatnonzero(bound)
        cell = cell[bound[cell] + could_add[cell // nb] >= THRESHOLD - 1e-9]
        if not len(cell):
            return []
        # what the skipped terms add in the blocks that are left
        n_skipped = np.bincount(passage[skipped], minlength=n)
        whose = cell // nb
        at, count = spread(begin[whose], begin[whose] + n_skipped[whose])  # the skipped terms stand first
        entry = self.entry_of(term[at], np.repeat(cell % nb, count))
        more = np.bincount(np.repeat(np.arange(len(cell)), count), np.where(entry >= 0, self.most[entry], 0.0), minlength=len(cell))
        cell = cell[bound[cell] + more >= THRESHOLD - 1e-9]
        # exact scores
        whose = cell // nb
        at, count = spread(begin[whose], begin[whose + 1])
        entry = self.entry_of(term[at], np.repeat(cell % nb, count))
        who, entry = np.repeat(whose, count)[entry >= 0], entry[entry >= 0]
        at, count = spread(self.first[entry], self.first[entry + 1])
        key, back = np.unique(np.repeat(who, count) * len(self.items) + self.item[at], return_inverse=True)
        score = np.bincount(back, self.weight[at], minlength=len(key))
        hit = score >= THRESHOLD
        return [(k // len(self.items) + base, k % len(self.items), s) for k, s in zip(key[hit].tolist(), score[hit].tolist(), strict=True)]

    def search(self, docs: list[list[str]]) -> Iterator[tuple[int, int, float, float, float]]:
        """(document's place, item_id, best score, question and answer overlap)."""
        get, step = self.term.get, self.passage // 2
        terms = [np.fromiter(map(get, w, [-1] * len(w)), np.int64, len(w)) for w in docs]
        starts = [np.arange(max(1, -(-(len(w) - step) // step))) * step for w in docs]
        doc_of = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        start_of = np.concatenate(starts)
        base = np.concatenate(([0], np.cumsum([len(s) for s in starts])))
        pairs = []
        for d, t in enumerate(terms):
            at = np.flatnonzero(t >= 0)
            last = np.minimum(at // step, len(starts[d]) - 1)
            pairs.append(((base[d] + last) * len(self.term)) + t[at])
            inner = (at // step > 0) & (at < start_of[base[d + 1] - 1] + self.passage)  # also in the passage before
            inner &= at - (at // step - 1) * step < self.passage
            before = np.minimum(at[inner] // step - 1, len(starts[d]) - 1)
            pairs.append(((base[d] + before) * len(self.term)) + t[at[inner]])
        pair = np.unique(np.concatenate(pairs))
        if not len(pair):
            return
        passage, term = pair // len(self.term), pair % len(self.term)
        best: dict[tuple[int, int], tuple[float, set[int]]] = {}
        cuts = np.searchsorted(passage, np.arange(0, len(doc_of), max(1, CELLS // self.n_blocks)))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(passage)], strict=True):
            for p, i, s in self.scored(passage[lo:hi], term[lo:hi]):
                was = best.get((int(doc_of[p]), i), (0.0, set()))
                best[int(doc_of[p]), i] = (max(s, was[0]), was[1] | {p})
        for (d, i), (s, ps) in best.items():
            question, answer, length = self.parts(i)
            found: set[str] = set()
            for p in ps:
                around = docs[d][max(0, int(start_of[p]) - length) : int(start_of[p]) + self.passage + length]
                for size in {len(x.split(" ")) for x in (next(iter(question)), next(iter(answer)))}:
                    found |= {" ".join(around[j : j + size]) for j in range(len(around) - size + 1)}
            q, a = len(question & found) / len(question), len(answer & found) / len(answer)
            if q >= OVERLAP and a >= OVERLAP:
                yield d, self.items[i], s, q, a


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified
    hit; documents without one have no row."""
    spark = docs.sparkSession
    items = cut(tokenised(benchmark, item_id, item_text))
    size = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.max(F.size("words"))).first()
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    if not size[0]:
        return spark.createDataFrame([], schema)
    shards = -(-size[0] // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    weights = cut(postings(items))
    out = None
    for s in range(shards):
        rows = weights.where(shard == s).select("term", "item_id", "w").toArrow()
        own = items.where(shard == s).collect()
        if not own:
            continue
        index = Index(rows["term"].to_pylist(), rows["item_id"].to_numpy(), rows["w"].to_numpy(), {r["item_id"]: r["words"] for r in own}, max(PASSAGE, 2 * size[1]))
        sent = spark.sparkContext.broadcast((index, {r["item_id"]: r["id"] for r in own}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index, ids = sent.value
            for b in batches:
                keys = b.column(0).to_pylist()
                hits = list(index.search([words_of(t) for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.array([keys[h[0]] for h in hits], pa.int64()), pa.array([ids[h[1]] for h in hits], pa.int64()), *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, schema)
        if shards > 1:  # one shard at a time is held anywhere
            found = cut(found)
            sent.unpersist(blocking=True)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)
