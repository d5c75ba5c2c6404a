"""Character tables for splitting texts before BPE merges."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Up to here the tables below are used; a text with later characters is split
#: by the tokenizer library, whose Unicode version may differ from Python's. The
#: lower case of these characters needs no table entry beyond it.
LAST = 0x17F


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies spell them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _ranges(points: list[int]) -> str:
    """A character class body for sorted code points."""
    out, i = "", 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out += f"\\u{points[i]:04x}-\\u{points[j]:04x}"
        i = j + 1
    return out


@lru_cache(maxsize=1)
def latin_classes() -> tuple[str, str, str]:
    """Class bodies for white space, letters and numbers up to LAST."""
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]
    kind = {c: unicodedata.category(chr(c))[0] for c in range(LAST + 1)}
    return _ranges(white), _ranges([c for c in kind if kind[c] == "L"]), _ranges([c for c in kind if kind[c] == "N"])
