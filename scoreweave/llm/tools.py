"""Small helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written as stored

__all__ = ["ALNUM", "LOWER", "alnum_words", "fold", "fresh", "mixed", "shingle_hashes", "space_words", "stored", "word_hashes"]

# The ASCII characters that lower-case, and the separators of two word rules.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ALNUM = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def fold(key: Column | str, parts: int) -> Column:
    """Fold number of a row: CRC-32 of the key's text modulo ``parts``; null for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string")) % parts


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than space and 0x09-0x0D."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(ALNUM).split()


_LETTER = np.random.default_rng(20240601).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def word_hashes(text: bytes, table: bytes) -> np.ndarray:
    """64-bit hash of every word of a text, all at once.

    ``table`` lower-cases letters and makes separators white space. A word's hash is the sum of its
    bytes, each times a random number of its place, mixed with the length.
    """
    out, start = [], 0
    text = text.translate(table)
    while start < len(text):
        stop = text.find(b" ", start + (1 << 20)) + 1 or len(text)
        data = np.frombuffer(text[start:stop], np.uint8)
        start = stop
        inside = (data != 32) & ((data < 9) | (data > 13))
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        sizes = edges[1::2] - edges[::2]
        if len(sizes):
            first = np.cumsum(sizes) - sizes
            letters = data[inside].astype(np.uint64) + np.uint64(1)
            place = np.arange(len(letters)) - np.repeat(first, sizes)
            total = np.add.reduceat(letters * (_LETTER[place & 4095] + (place >> 12).astype(np.uint64)), first)
            out.append(mixed(total + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and shift)."""
    x = values ^ (values >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, by start; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[i : i + n]
        total ^= total >> np.uint64(29)
    return mixed(total)
