"""Order-preserving packing of documents into sequences of a fixed number of tokens.

The documents of a partition, each ended by an id of its own, are one stream of
tokens in the order of the table. Dynamic programming chooses the cuts between
sequences: the cost of a sequence is its padding (none where its length is the
full one or a power of two) and SEQUENCE, that of a cut is 0 at the end of a
document, SENTENCE within one at the end of a sentence and WORD elsewhere. With
f(j) the least cost of cutting at place p(j),

    f(j) = cut(j) + SEQUENCE + min(width - p(j) + min over the window of f(i) + p(i),
                                   min over powers of two q with p(i) = p(j) - q of f(i)),

so the inner minimum is kept in a monotone queue. Places to cut at are the ends
of documents and, at most one in STEP tokens, the ends of sentences; where none
comes for LONGEST tokens there is one in STEP tokens, and in the last width of tokens
of a partition each token is one. Powers of two below LEAST_POWER are looked at
there only: they cost more sequences than padding saves.

A task holds CHUNK tokens (or one document, if that is longer): the sequences
that end well before the last place are final, the rest goes on with the next
documents. Nothing is shuffled, and a task that is run again gives the same rows.

Cases: a null or empty text is one piece of the ending id alone; a text of any
length is encoded whole and cut into as many pieces as it needs; repeated rows
are packed one by one; a null id is carried; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches
from .bytebpe import load

#: Costs in tokens of padding.
SEQUENCE, SENTENCE, WORD = 8, 4, 12
#: Tokens in which one place to cut is enough; tokens without a sentence's end after
#: which there are others; the least length of a short sequence before the last
#: ones; tokens that are packed together.
STEP, LONGEST, LEAST_POWER, CHUNK = 16, 96, 256, 400_000
#: Marks that end a sentence and what may close it behind them.
MARKS, CLOSERS = (b".", b"!", b"?"), b"\"')]"


class Places:
    """Which tokens of a vocabulary end a sentence or begin with white space."""

    def __init__(self, tokens: list[bytes]):
        self.stop = np.array([t.rstrip(CLOSERS).endswith(MARKS) for t in tokens] + [False])
        self.line = np.array([t.endswith(b"\n") for t in tokens] + [False])
        self.space = np.array([t[:1] in (b" ", b"\n", b"\t", b"\r") for t in tokens] + [False])

    def sentences(self, ids: np.ndarray) -> np.ndarray:
        """Places at which a sentence has ended."""
        known = np.minimum(ids, len(self.stop) - 1)
        return np.flatnonzero((self.stop[known[:-1]] & self.space[known[1:]]) | self.line[known[:-1]]) + 1


def cuts(ends: np.ndarray, costs: np.ndarray, width: int, tail: int = 0) -> list[int]:
    """Numbers of the places at which the least costly sequences end. ends: rising
    places, the first above 0, no two further apart than width. tail: from where on
    sequences may have any power of two as their length."""
    n = len(ends)
    full = np.concatenate(([0], ends))
    #: Places that are a power of two behind another one.
    exact: dict[int, list[int]] = {}
    for q in (1 << k for k in range(width.bit_length()) if 1 << k < width):
        ask = np.arange(np.searchsorted(full, max(q, 0 if q >= LEAST_POWER else tail + q)), n + 1)
        found = np.minimum(np.searchsorted(full, full[ask] - q), n)
        for j, e in zip(ask[hit := full[found] == full[ask] - q].tolist(), found[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(e)
    at, least = full.tolist(), [0] * (n + 1)  # least: f(j) + p(j)
    back = [0] * (n + 1)
    queue = deque([0])
    append, drop, shift = queue.append, queue.pop, queue.popleft
    first, gone, get = 0, width, exact.get
    for j, (p, cost) in enumerate(zip(at[1:], (costs + SEQUENCE).tolist(), strict=True), 1):
        while gone < p:  # the front is more than the width away
            shift()
            first = queue[0]
            gone = at[first] + width
        i, low = first, least[first] + width
        if (others := get(j)) is not None:
            for e in others:
                if least[e] - at[e] + p < low:
                    i, low = e, least[e] - at[e] + p
        least[j] = low = low + cost
        back[j] = i
        while queue and least[queue[-1]] >= low:
            drop()
        if not queue:
            first, gone = j, p + width
        append(j)
    out, j = [], n
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


class Packer:
    """Takes a partition's documents one by one; gives pieces as (number of the
    document, start, length, sequence, offset)."""

    def __init__(self, places: Places, width: int):
        self.places, self.width = places, width
        self.sequence = 0
        self.docs: list[tuple[int, int, np.ndarray]] = []  # number, ids that are packed already, ids
        self.held = 0

    def add(self, number: int, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        self.docs.append((number, 0, ids))
        self.held += len(ids)
        if self.held >= CHUNK:
            yield from self.pack(False)

    def candidates(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places to cut the held tokens at, and what each costs."""
        total = self.held
        ends = np.cumsum([len(ids) - done for _, done, ids in self.docs])
        sentence = self.places.sentences(np.concatenate([ids[done:] for _, done, ids in self.docs]))
        sentence = sentence[np.flatnonzero(np.diff(sentence // STEP, append=total))]  # the last one of each step
        natural = np.union1d(ends, sentence)
        before = np.concatenate(([0], natural[:-1]))
        far = np.flatnonzero(natural - before > LONGEST)
        more = [np.arange(a + STEP, b, STEP) for a, b in zip(before[far].tolist(), natural[far].tolist(), strict=True)]
        if last:
            more.append(np.arange(max(1, total - self.width), total))
        at = np.union1d(natural, np.concatenate(more)) if more else natural
        cost = np.full(len(at), WORD)
        cost[np.searchsorted(at, sentence)] = SENTENCE
        cost[np.searchsorted(at, ends)] = 0
        return at.astype(np.int64), cost

    def pack(self, last: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """Packs what is held; without `last` only up to two widths before its end."""
        if not self.docs:
            return
        at, cost = self.candidates(last)
        until = at[cuts(at, cost, self.width, self.held - self.width if last else self.held)]
        if not last:
            until = until[until <= self.held - 2 * self.width]
        k, done, left = 0, self.docs[0][1], []
        begin = 0
        for end in until.tolist():
            offset = 0
            while begin + offset < end:
                number, _, ids = self.docs[k]
                take = min(len(ids) - done, end - begin - offset)
                yield number, done, take, self.sequence, offset
                offset += take
                done += take
                if done == len(ids):
                    k, done = k + 1, 0
            self.sequence += 1
            begin = end
        if k < len(self.docs):
            number, _, ids = self.docs[k]
            left = [(number, done, ids), *self.docs[k + 1 :]]
        self.docs, self.held = left, self.held - begin


def pack(docs: DataFrame, path: str, width: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every
    piece. width has to be a power of two."""
    if width & (width - 1):
        raise ValueError("width is no power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        packer = Packer(Places(bpe.tokens), width)
        base = TaskContext.get().partitionId() << 40
        keys: dict[int, tuple[int | None, np.ndarray]] = {}
        number = 0

        def rows(pieces: Iterator[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
            got = list(pieces)
            if not got:
                return
            crc = [zlib.crc32(keys[n][1][start : start + length].astype("<u4").tobytes()) for n, start, length, _, _ in got]
            column = lambda c: pa.array([g[c] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[g[0]][0] for g in got], pa.int64()), column(1), column(2), pa.array(crc, pa.int64()), pa.array([len(keys[g[0]][1]) for g in got], pa.int64()), pa.array([base + g[3] for g in got], pa.int64()), column(4)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            held = {d[0] for d in packer.docs}
            for n in [n for n in keys if n not in held]:
                del keys[n]

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.encode(t or ""), end_id).astype(np.int64)
                keys[number] = (i, ids)
                yield from rows(packer.add(number, ids))
                number += 1
        yield from rows(packer.pack(True))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, schema)
