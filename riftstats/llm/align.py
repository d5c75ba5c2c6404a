"""Alignment of two tokenizers' tokens of the same texts.

Each text is encoded by a byte-level tokenizer A and a piece tokenizer B. The
cumulative ends of A's tokens, in bytes, go into a dictionary from end to index;
B's ends, in order, are looked up in it, and those found slice both id lists into
groups. A link joins an A and a B token whose byte ranges end together: the last
tokens of each slice. A pair of ids is counted over all links of the corpus.

One map pass over the texts gives each document's groups and its distinct linked
pairs with their times, which are kept in the shared folder. The pairs' counts are
pre-aggregated within tasks and then summed; they go back to the documents by a
join whose small side is broadcast after a check of its size. Beyond that size
the join is shuffled; a frequent pair is in most documents, so each pair is then
dealt to SALTS parts.

Cases: null and empty texts, and texts that one side doesn't keep byte by byte
(such as those whose white space the piece tokenizer changes), have no tokens:
zeros and an empty text of groups; special strings are plain text; a text of any
length is aligned whole; repeated rows count as often as they occur; a null id is
carried; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .base import map_batches, written

#: Pairs whose counts are sent to every executor at most (three numbers each);
#: parts that each pair is dealt to beyond that.
PAIRS_SENT, SALTS = 500_000, 64
#: A pair is one number: A's id times this, plus B's id.
B_IDS = 1 << 24


class Pieces:
    """A piece model and the bytes of its ids."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = [self.bytes_of(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        """A piece's text with U+2581 as a space; <0xHH> is the byte HH."""
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("\u2581", " ").encode("utf-8")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def slices(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last token of each group on both sides, in order."""
    a_at = dict(zip(a_ends.tolist(), range(len(a_ends)), strict=True))
    at = np.fromiter(map(a_at.get, b_ends.tolist(), repeat(-1)), np.int64, len(b_ends))
    y = np.flatnonzero((at >= 0) & (np.diff(b_ends, append=-1) != 0))  # of tokens that end together the last one
    return at[y], y


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = bytebpe.load(a_path), load(b_path)
        self.a_size, self.b_size = (np.array(list(map(len, side.tokens)), np.int64) for side in (self.a, self.b))
        # ids with what follows them: within A's side and behind it, within B's side and behind it
        sides = ((self.a_size, ","), (self.a_size, "|"), (self.b_size, ","), (self.b_size, ";"))
        self.spelt_ids = np.array([f"{i}{mark}" for size, mark in sides for i in range(len(size))], object)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides of each text, none if one of them doesn't keep it.
        A's tokens are taken from the text one after another, so they are the text
        if they are as long; B may change characters."""
        none = np.zeros(0, np.int64)
        for text, b in zip(texts, self.b.encode([t or "" for t in texts]), strict=True):
            whole = b" " + (text or "").encode("utf-8")
            if not text or b"".join(map(self.b.tokens.__getitem__, b)) != whole:
                yield none, none
                continue
            a = self.a.encode_plain(" " + text).astype(np.int64)
            yield (a, np.array(b, np.int64)) if int(self.a_size[a].sum()) == len(whole) else (none, none)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return slices(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))

    def spelt(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> str:
        """The groups as a1,a2|b1;a3|b2,b3: each id is put behind the other side's ids of
        the groups before it (B's behind A's of its own group too)."""
        if not len(x):
            return ""
        n_a, n_b, out = len(self.a_size), len(self.b_size), np.empty(len(a) + len(b), np.int64)
        a_text, b_text = a.copy(), b + 2 * n_a
        a_text[x] += n_a
        b_text[y] += n_b
        out[np.arange(len(a)) + np.repeat(np.append(0, y[:-1] + 1), np.diff(x, prepend=-1))] = a_text
        out[np.arange(len(b)) + np.repeat(x + 1, np.diff(y, prepend=-1))] = b_text
        return "".join(self.spelt_ids[out].tolist())[:-1]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct
    linked pairs with their times, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                numbers, digests, pairs, times, ends = [], [], [], [], [0]
                for a, b in aligner.tokens(part.column(1).to_pylist()):
                    row += 1
                    x, y = aligner.groups(a, b)
                    own, count = np.unique(a[x] * B_IDS + b[y], return_counts=True)
                    digests.append(hashlib.sha256(aligner.spelt(a, b, x, y).encode()).hexdigest() if len(a) else "")
                    numbers.append((row, len(a), len(b), len(x), len(x)))
                    pairs.append(own)
                    times.append(count)
                    ends.append(ends[-1] + len(own))
                rows, *counts = ([n[c] for n in numbers] for c in range(5))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times), pa.int32(), safe=True))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return written(map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, schema), "aligned")


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, links (in the whole corpus) and best: whether no pair of the same B id
    has more. linked: pair, times."""
    counts = linked.groupBy("pair").agg(F.sum("times").alias("links"))
    counts = written(counts, "pair-counts")
    most = counts.groupBy((F.col("pair") % B_IDS).alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", F.col("pair") % B_IDS).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of
    every document."""
    rows = aligned(docs, a_path, b_path, id_col, text_col)
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    counts = written(pair_counts(linked), "pair-counts")
    if counts.count() <= PAIRS_SENT:
        joined = linked.join(F.broadcast(counts), "pair")
    else:
        dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = linked.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["pair", "salt"])
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("times")).alias("count_sum"))
    got = rows.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
