"""A byte-level vocabulary file, encoded by the tiktoken library.

The file names tokens in a printable alphabet and lists merges in order; tokens
made by merges have ids in the same order, so ids are ranks, which is checked when
a file is read. Splitting and merging are the library's; the pattern is that of
the file's pre-tokenizer.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

from .pretoken import byte_alphabet


class ByteVocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("the ids of merged tokens are not in the order of merges")
        size = 1 + max([*ranks.values(), *self.special.values()])
        #: The bytes of each id.
        self.tokens = [b""] * size
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = token
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special strings in it are special tokens."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def encode_plain(self, text: str) -> np.ndarray:
        """Ids of a text; special strings in it are ordinary text."""
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


@lru_cache(maxsize=2)
def load(path: str) -> ByteVocabulary:
    """The vocabulary of a file, read once a worker."""
    return ByteVocabulary(path)
