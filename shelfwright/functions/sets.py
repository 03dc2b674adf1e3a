"""Sets of tokens and of character grams over Arrow batches: their sizes, 128-bit images and shared members.

An image has, for each of its bits, the parity of the set's members whose hash is that bit; sets that differ in d members have images that
differ in at most d bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_MEMO = 1 << 20
_PAD = "\U0010ffff"  # no character


def gram_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct character k-grams of each text, by text and hash; a shorter text is its own only one.

    Hashes are the same on every machine.
    """
    lengths = np.array([max(len(x), k) for x in texts], dtype=np.int64)
    codes = np.frombuffer("".join(x if len(x) >= k else x.ljust(k, _PAD) for x in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    runs = lengths - (k - 1)
    doc = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(doc)) + doc * (k - 1)
    h = np.zeros(len(doc), dtype=np.uint64)
    for i in range(k):
        h = (h ^ codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h.view(np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def images(h: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The two halves of the image of each set; the sets' hashes follow each other from `start` on."""
    bit, low = np.uint64(1) << (h & 63).astype(np.uint64), (h & 64) == 0
    return [np.bitwise_xor.reduceat(np.where(low == half, bit, np.uint64(0)), start).view(np.int64) for half in (True, False)]


def shared(left: list[str], right: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many k-grams the texts of each pair have in common, and how many in all."""
    n = len(left)
    doc, h = gram_sets(left + right, k)
    doc = doc % n
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    common = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=n)
    return common, np.bincount(doc, minlength=n) - common


class TokenImages:
    """Images of sets of tokens as numbers of 128 bits; remembers what it has hashed."""

    def __init__(self) -> None:
        self.bits: dict[str, int] = {}

    def of(self, tokens: dict[str, None]) -> int:
        image = 0
        for t in tokens:
            bit = self.bits.get(t)
            if bit is None:
                if len(self.bits) >= _MEMO:
                    self.bits.clear()
                bit = self.bits[t] = 1 << (hashlib.blake2b(t.encode(), digest_size=1).digest()[0] & 127)
            image ^= bit
        return image


def near_enough(share: float) -> Column:
    """Whether sets of am and bm members with the images (aw0, aw1) and (bw0, bw1) may have this Jaccard similarity; never false for those that do."""
    a, b = F.col("am"), F.col("bm")
    differ = F.bit_count(F.col("aw0").bitwiseXOR(F.col("bw0"))) + F.bit_count(F.col("aw1").bitwiseXOR(F.col("bw1")))
    return (F.least(a, b) >= F.greatest(a, b) * share - 1e-9) & (a + b - differ >= 2 * needed(share))


def needed(share: float) -> Column:
    """The members that sets of am and bm members must have in common."""
    return F.ceil((F.col("am") + F.col("bm")) * (share / (1 + share)) - 1e-9)
