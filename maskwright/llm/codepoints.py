"""Batches of texts as one array of code points, with vectorised word tokens.

All tables are built by rule from the Unicode database of the Python runtime; they have a fixed
size (one entry per code point) and are built once per Python worker.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

SPACE, WORD, DIGIT, PUNCT, HAN, KANA, THAI = range(7)
_TOP = 0x110000


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, its folded form: width folded and lower case, one to one)."""
    kind = np.full(_TOP, PUNCT, np.uint8)
    fold = np.arange(_TOP, dtype=np.uint32)
    for c in range(0x32400):
        if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0x2A6E0 < c < 0x2F800:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] in "LM":
            kind[c] = WORD
            low = ch.lower()
            if len(low) == 1:
                fold[c] = ord(low)
        elif cat == "Nd":
            kind[c] = DIGIT
        elif ch.isspace() or cat in ("Zs", "Zl", "Zp"):
            kind[c] = SPACE
        if 0xFF01 <= c <= 0xFF5E:
            narrow = chr(c - 0xFEE0)
            fold[c] = ord(narrow.lower())
            kind[c] = WORD if narrow.isalpha() else DIGIT if narrow.isdigit() else PUNCT
    for lo, hi in ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2F800, 0x2FA1F), (0x3005, 0x3007)):
        kind[lo : hi + 1] = HAN
    for lo, hi in ((0x3041, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)):
        kind[lo : hi + 1] = KANA
    kind[0x0E01:0x0E3B] = THAI
    kind[0x0E40:0x0E4F] = THAI
    fold[0x3000] = 0x20
    return kind, fold


def joined(texts: list[str], sep: str = "\x00") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by ``sep``, and the start of each text."""
    cps = np.frombuffer((sep.join(texts) + sep).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return cps, starts


_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _powers(n: int = 1 << 16) -> np.ndarray:
    return np.cumprod(np.full(n, np.uint64(0x100000001B3)), dtype=np.uint64)


def hash_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of codes[start:end] for sorted, disjoint spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    pos = np.arange(len(codes), dtype=np.int64)
    own = np.zeros(len(codes) + 1, np.int64)
    own[starts] = 1
    span = np.cumsum(own[:-1]) - 1
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    mask = np.cumsum(inside[:-1]) > 0
    at = pos[mask]
    k = at - starts[span[mask]]
    pw = _powers()
    mixed = (codes[at].astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    vals = mixed * pw[k & 0xFFFF]
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    return np.add.reduceat(vals, first)
