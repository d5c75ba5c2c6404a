"""Language identification with string kernels.

A text is the set of its character n-grams of lengths 1 to 4 (the blended
spectrum), letters only, lower case, white space as one blank. The presence
kernel of two texts is the number of n-grams that they share over the root of
the product of their set sizes; n-grams are hashed to DIMS cells. A Nystroem map
through landmark texts turns it into short vectors, on which one ridge
regression per language is fitted (one versus the rest). The score is linear in
the shared n-grams, so the landmarks are folded into one weight per n-gram and
language.

A long text is read in pieces of equal length, at most PIECE characters, and its
vector is the mean of theirs, in training as in scoring: no set of n-grams fills
the cells, and the score doesn't fall with the length of a text. Nor does it with
its shortness: a piece with fewer n-grams than the landmarks have on average
shares few with any of them, so it counts by the part of its n-grams that is shared.

Landmarks and training rows are a bounded sample (PER_LANG labelled rows of a
language, by the hash of their id), the landmarks cut to pieces of LANDMARK_CHARS;
every document is scored on its whole text.

Cases: a text that is null or has no letter is `und` with score 0; rows whose
lang or doc_id is null are not learnt from; a null doc_id is not held out; with
no labelled row at all every text is `und`; ties between languages go to the
alphabetically first; repeated rows give repeated results; an empty table gives
an empty result; other columns are not read.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import small_batches

NGRAMS = (1, 2, 3, 4)
BITS = 20
DIMS = 1 << BITS
#: Bounds of the sample that is learnt from.
PER_LANG, LANDMARKS_PER_LANG, LANDMARK_CHARS = 200, 24, 2000
RIDGE, FLOOR = 1.0, 1e-6
#: Most characters of a piece: some 10,000 different n-grams at most, a
#: hundredth of the cells.
PIECE = 1 << 13


LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def numerals() -> np.ndarray:
    """Whether a code point is a sign that counts as a number only, such as \u00bd,
    \u00b2 or \u2167: word characters, but neither digits nor letters."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x20000) if chr(c).isnumeric() and not chr(c).isalpha()]] = True
    return out


def letter_runs(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    low = (text or "").lower()
    if not low.isascii():
        code = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        sign = numerals()[code]
        if sign.any():
            low = np.where(sign, np.uint32(32), code).tobytes().decode("utf-32-le")
    return LETTERS.findall(low)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The distinct cells of the n-grams of each piece of a text, none if it has
    no letter. n-grams across a border belong to the piece that they begin in."""
    line = " " + " ".join(letter_runs(text)) + " "
    if len(line) < 3:
        return
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    n = -(-len(code) // PIECE)
    stamp = np.empty(DIMS, np.int32)
    for k in range(n):
        c = code[len(code) * k // n : len(code) * (k + 1) // n + max(NGRAMS) - 1].astype(np.uint64)
        h, cells = np.zeros(len(c), np.uint64), []
        for i in NGRAMS:
            if len(c) < i:
                break
            h = h[: len(c) - i + 1] * np.uint64(0x100000001B3) + c[i - 1 :]
            mixed = (h + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
            cells.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        every = np.concatenate(cells)
        place = np.arange(len(every), dtype=np.int32)
        stamp[every] = place  # the last place of a cell stays
        yield every[stamp[every] == place]


class Model:
    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (lang, text)."""
        self.langs = sorted({lang for lang, _ in rows})
        seen: dict[str, int] = {}
        marks = []
        for lang, text in rows:
            if seen.setdefault(lang, 0) < LANDMARKS_PER_LANG:
                seen[lang] += 1
                marks.append(text[:LANDMARK_CHARS])
        cells = [next(pieces(t), np.zeros(0, np.int64)) for t in marks]
        known = np.unique(np.concatenate(cells))
        self.usual = sum(map(len, cells)) / len(cells)  # n-grams of a landmark
        self.row = np.full(DIMS, len(known), np.int32)  # the last row stands for all other cells
        self.row[known] = np.arange(len(known), dtype=np.int32)
        self.weight = np.zeros((len(known) + 1, len(marks)), np.float32)  # of an n-gram for a landmark
        for i, c in enumerate(cells):
            self.weight[self.row[c], i] = 1 / np.sqrt(max(len(c), 1))
        value, vector = np.linalg.eigh((self.weight.T @ self.weight).astype(np.float64))
        keep = value > FLOOR
        to_phi = vector[:, keep] / np.sqrt(value[keep])
        phi = np.stack([self.mean(t)[0] for _, t in rows]) @ to_phi
        phi = np.concatenate((phi, np.ones((len(phi), 1))), axis=1)
        y = np.array([[1.0 if lang == x else -1.0 for x in self.langs] for lang, _ in rows])
        weight = 1 / np.array([sum(lang == x for x, _ in rows) for lang, _ in rows])  # languages count alike
        weight *= len(rows) / weight.sum()
        left = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
        w = np.linalg.solve(left, phi.T @ (y * weight[:, None]))
        self.weight = self.weight @ (to_phi @ w[:-1])  # of an n-gram for a language
        self.bias = w[-1]

    def mean(self, text: str | None) -> tuple[np.ndarray, int]:
        """Mean over the pieces of the weights of their n-grams, each over the root
        of the number of its n-grams (lower if that is less than a landmark's); and
        the number of pieces."""
        total, n = np.zeros(self.weight.shape[1]), 0
        for cells in pieces(text):
            rows = self.row[cells]
            total += self.weight[rows].sum(axis=0, dtype=np.float64) / np.sqrt(len(cells)) * np.sqrt(max(1, self.usual / len(cells)))
            n += 1
        return total / max(n, 1), n

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        got = [self.mean(t) for t in texts]
        none = np.array([n == 0 for _, n in got], bool)
        f = np.array([m for m, _ in got]).reshape(len(got), len(self.langs)) + self.bias
        best = f.argmax(axis=1)
        score = np.clip((f.max(axis=1) + 1) / 2, 0, 1)
        return ["und" if z else self.langs[b] for b, z in zip(best.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, score)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    own = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    ids = own.select(id_col, lang_col).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PER_LANG)
    picked = [r[0] for r in ids.select(id_col).collect()]  # at most PER_LANG a language
    if not picked:
        return None
    one = F.min_by(F.struct(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), F.struct(F.xxhash64(text_col), lang_col))  # of an id with several texts always the same
    rows = own.where(F.col(id_col).isin(picked)).groupBy(id_col).agg(one.alias("one")).collect()
    rows = [(r.one.lang, r.one.text) for r in sorted(rows, key=lambda r: r[0])]
    return Model(rows)


def annotated(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a struct<lang_pred, score> named `out`, predicted from
    their whole texts by a model fitted on their labelled rows."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        langs, score = model.value(texts) if model.value else (["und"] * len(texts), np.zeros(len(texts)))
        return pd.DataFrame({"lang_pred": langs, "score": score})

    return docs.withColumn(out, predict(F.col(text_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    scored = annotated(docs.select(id_col, text_col, lang_col), "_p", id_col, text_col, lang_col)
    return scored.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), "_p.lang_pred", "_p.score")
