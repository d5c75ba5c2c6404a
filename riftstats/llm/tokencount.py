"""Token counts with a whole-token shortcut.

Offline (once, on the driver) every vocabulary string is encoded alone; those
that come out as one token are proved shortcuts and are broadcast (the size is
that of the vocabulary). A pre-token found there counts one at once; only the
rest is merged, and remembered in a bounded table.

Cases: a null or empty text has 0 bytes and 0 tokens; a text of any length is
counted whole, pre-token by pre-token; special strings count as
one token each, as the library takes them; repeated rows, null ids and extra
columns are carried or ignored as in bpe; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches
from .pretoken import LAST, byte_alphabet, latin_classes

CACHE_WORDS = 500_000


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.vocab = [raw(s) for s in spec["model"]["vocab"]]
        self.single_bytes = [bytes([b]) for b in range(256)]

    def merge(self, word: bytes) -> int:
        """Number of tokens of one pre-token."""
        parts = [self.single_bytes[b] for b in word]
        rank = self.rank
        ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == 1 << 30:
                break
            if len(ranks) > 64:
                return self.merge_long(parts)
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), 1 << 30)
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), 1 << 30)
        return len(parts)

    def merge_long(self, parts: list[bytes]) -> int:
        """As merge, for very long pre-tokens: a heap over a linked list."""
        import heapq

        n = len(parts)
        sym: list[bytes | None] = list(parts)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            a, j = sym[i], nxt[i]
            if a is None or j < 0 or self.rank.get((a, sym[j])) != r:
                continue
            sym[i], sym[j], nxt[i] = a + sym[j], None, nxt[j]
            left -= 1
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (x := self.rank.get((sym[p], sym[q]))) is not None:
                    heapq.heappush(heap, (x, p))
        return left

    def whole(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token's bytes and encode alone as
        one token."""
        out = set()
        for token in self.vocab:
            try:
                text = token.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.merge(token) == 1:
                out.add(text)
        return frozenset(out)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The vocabulary of a file, read once a worker."""
    return ByteBpe(path)


class Counter:
    def __init__(self, bpe: ByteBpe, whole: frozenset[str]):
        self.bpe, self.whole = bpe, whole
        space, letter, number = latin_classes()
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.beyond = re.compile(f"[^\x00-{chr(LAST)}]")
        self.special = re.compile("|".join(map(re.escape, bpe.special))) if bpe.special else None
        self.known: dict[str, int] = dict.fromkeys(whole, 1)
        self.library = None

    def split(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.words.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.bpe.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def __call__(self, text: str) -> int:
        pieces, total = [text], 0
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
            total = len(pieces) - 1
        known = self.known
        for piece in pieces:
            words = self.split(piece)
            try:
                total += sum(map(known.__getitem__, words))
            except KeyError:
                if len(known) > CACHE_WORDS:
                    known = self.known = dict.fromkeys(self.whole, 1)
                for w in words:
                    if w not in known:
                        known[w] = self.bpe.merge(w.encode("utf-8"))
                total += sum(map(known.__getitem__, words))
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    sc = docs.sparkSession.sparkContext
    whole = sc.broadcast(load(path).whole())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(load(path), whole.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    out = map_batches(docs.select(F.col(id_col).cast("long"), text_col, size), run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
