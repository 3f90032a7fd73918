"""Word shingles of whole texts as sorted 64-bit hashes, and MinHash signatures of them.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case. A text of fewer words than a
shingle has one shingle, all its words; a text without words, or null, has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
MEMO_ENTRIES = 150_000
_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Odd multipliers, one per word of a shingle and per hash function, from a fixed rule.
_ODD = np.array([xxhash.xxh3_64_intdigest(f"odd {i}") | 1 for i in range(512)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hash = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of the text's shingles, sorted."""
    found = text.lower().encode("utf-8", "replace").translate(_SPACED).split() if text else []
    h = np.fromiter(map(_hash.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = (total ^ h[i : len(h) - n + 1 + i]) * _ODD[i]
        total ^= total >> np.uint64(32)
    return np.unique(_mixed(total))


def signature(found: np.ndarray, functions: int) -> np.ndarray:
    """The least value of the shingles under each of the hash functions, as 32-bit integers."""
    least = np.full(functions, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 4096):
            part = found[i : i + 4096, None] * _ODD[None, 100 : 100 + functions]
            least = np.minimum(least, part.min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def digest(found: np.ndarray) -> str | None:
    """Names the set of shingles; null for the empty one."""
    return xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None
