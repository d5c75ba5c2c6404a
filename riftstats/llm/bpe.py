"""BPE encoding and decoding over a pair occurrence index.

The words (pre-tokens) of a slice of a partition are laid out once in one flat
symbol array. An index maps each mergeable pair to all its positions there; the
active pairs are applied in ascending rank, each merge rewrites its positions
and enters the pairs it creates into the index. A merge only makes symbols of a
higher rank, so one ascending pass gives what merging word by word gives.

Cases: a null or empty text has no tokens and decodes to the empty string; a text
of any length is encoded whole (its words are those of one slice or more);
repeated rows give repeated results; a null doc_id is carried as null; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches
from .pretoken import LAST, byte_alphabet, latin_classes

#: Characters of text whose new words share one pair index, and words whose
#: encoding a task remembers before it starts afresh; both bound a task's memory.
SLICE_CHARS = 24_000_000
CACHE_WORDS = 500_000
#: Ranks with fewer positions than this are merged one by one.
SCALAR_BELOW = 20


class WordBpe:
    """Vocabulary and merges of a tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [""] * self.size
        for k, v in [*vocab.items(), *self.special.items()]:
            self.token[v] = k
        letters = byte_alphabet()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left * self.size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.special_start = os.path.commonprefix(list(self.special))  # a text without it has no special token
        space, letter, number = latin_classes()
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.beyond = re.compile(f"[^\x00-{chr(LAST)}]")
        self._library = None

    def split(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without special tokens. Texts beyond
        the Latin blocks take the library's Unicode tables."""
        if not self.beyond.search(text):
            return self.words.findall(text.lower())  # white space is dropped anyway
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._byte = {c: b for b, c in byte_alphabet().items()}
        plain = self._library.normalizer.normalize_str(text)
        return [bytes(self._byte[c] for c in piece).decode("utf-8") for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key, -1 if the pair never merges."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and tokens per word."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        n, size = len(raw), self.size
        sym = self.inner[raw].astype(np.int64)
        sym[ends - 1] = self.last[raw[ends - 1]]
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - lengths] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Adds the pairs that begin at these positions to the index."""
            rank = self.ranks(sym[at] * size + sym[nxt[at]])
            if not (keep := rank >= 0).all():
                at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        def enter_one(p: int) -> None:
            r = self.rank.get(int(sym[p]) * size + int(sym[nxt[p]]))
            if r is not None:
                if r in index:
                    index[r].append(np.array([p]))
                else:
                    index[r] = [np.array([p])]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            a, b, made = int(self.left[r]), int(self.right[r]), int(self.made[r])
            at = found[0] if len(found) == 1 else np.concatenate(found)
            if len(at) < SCALAR_BELOW or a == b:
                for p in sorted(at.tolist()):  # leftmost first, for a pair of equal symbols
                    q = int(nxt[p])
                    if q < 0 or sym[p] != a or sym[q] != b:
                        continue
                    after, before = int(nxt[q]), int(prv[p])
                    sym[p], sym[q], nxt[p] = made, -1, after
                    if after >= 0:
                        prv[after] = p
                        enter_one(p)
                    if before >= 0:
                        enter_one(before)
                continue
            at = np.unique(at)
            q = nxt[at]
            ok = (sym[at] == a) & (q >= 0)
            at, q = at[ok], q[ok]
            ok = sym[q] == b
            at, q = at[ok], q[ok]
            after = nxt[q]
            sym[at], sym[q], nxt[at] = made, -1, after
            more = after >= 0
            prv[after[more]] = at[more]
            before = prv[at]
            enter(np.unique(np.concatenate((before[before >= 0], at[more]))))
        live = sym >= 0
        upto = np.concatenate(([0], np.cumsum(live)))
        return sym[live].astype(np.int32), upto[ends] - upto[ends - lengths]


class Known(dict):
    """Word to number; a word that is asked for the first time gets the next."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = i = len(self)
        return i


class Encoder:
    """Splits texts one by one, encodes the new words of a slice together and
    remembers words, up to CACHE_WORDS."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.forget()

    def forget(self) -> None:
        self.known, self.decoded, self.used = Known(), [], 0
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for content, i in self.bpe.special.items():
            self.known[content]  # noqa: B018
            self.learn(np.array([i], np.int32), np.array([1]))
        self.docs: list[np.ndarray] = []
        self.known.new = []

    def learn(self, ids: np.ndarray, count: np.ndarray) -> None:
        ends = np.cumsum(count)
        token = self.bpe.token
        names = [token[i] for i in ids.tolist()]
        lo = 0
        for hi in ends.tolist():
            self.decoded.append(" ".join(names[lo:hi]))
            lo = hi
        self.start = np.concatenate((self.start, self.used + ends - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, ids))
        self.used += len(ids)

    def add(self, text: str | None) -> None:
        text = text or ""
        pieces = self.bpe.special_split.split(text) if self.bpe.special_split and self.bpe.special_start in text else [text]
        words = self.bpe.split(pieces[0])
        for i, piece in enumerate(pieces[1:], 1):
            words += [piece] if i % 2 else self.bpe.split(piece)
        self.docs.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))

    def flush(self) -> Iterator[tuple[np.ndarray, str]]:
        self.learn(*self.bpe.encode_words([w.encode("utf-8") for w in self.known.new]))
        self.known.new = []
        get = self.decoded.__getitem__
        for at in self.docs:
            n = self.count[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(total)]
            yield ids, " ".join(map(get, at.tolist()))
        self.docs = []
        if len(self.known) > CACHE_WORDS:
            self.forget()

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        for text in texts:
            self.add(text)
        return list(self.flush())


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path))

        def results(keys: list) -> Iterator[pa.RecordBatch]:
            done = encoder.flush()
            for i in range(0, len(keys), 64):
                part = list(islice(done, 64))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x, _ in part]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for x, _ in part])))
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 64], pa.int64()), ids, pa.array([x for _, x in part], pa.string())], names=["doc_id", "ids", "decoded"])
            next(done, None)

        keys: list = []
        held = 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                encoder.add(t)
                held += len(t or "")
                if held >= SLICE_CHARS:
                    yield from results(keys)
                    keys, held = [], 0
        if keys:
            yield from results(keys)

    return map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded to a DataFrame with an array of ids, by a join-free lookup
    in the vocabulary, which is a literal of fixed size."""
    spark = encoded.sparkSession
    token = spark.sparkContext.broadcast(load(path).token)

    @F.pandas_udf("string")
    def text(ids):  # noqa: ANN001, ANN202
        return ids.map(lambda x: None if x is None else " ".join(token.value[i] for i in x))

    return encoded.withColumn("decoded", text(ids_col))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Token counts and digests of encode_decode's result, with more of its
    columns if they are named."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
