"""Words, and sets of word shingles as arrays, for whole batches of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import xxhash

#: A word is a longest run of Unicode letters and digits.
find_words: Callable[[str], list[str]] = re.compile(r"[^\W_]+").findall

_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Entries that a task's cache of word hashes may have before it starts anew.
CACHE = 1 << 18


class WordHashes(dict):
    """64-bit hashes of words, each computed when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * _C[2]
    h = (h ^ (h >> np.uint64(27))) * _C[3]
    return h ^ (h >> np.uint64(31))


class ShingleSets:
    """The distinct shingles of the texts of a batch that have at least ``min_words`` words.

    ``text`` numbers the kept texts within the batch; set i is ``hashes[start[i]:start[i + 1]]``,
    ascending.
    """

    def __init__(self, texts: Iterable[str | None], width: int, min_words: int, cache: WordHashes):
        get, kept, lengths, flat = cache.__getitem__, [], [], []
        for i, t in enumerate(texts):
            if t:
                words = find_words(t.lower())
                if len(words) >= max(min_words, width):
                    kept.append(i)
                    lengths.append(len(words))
                    flat += map(get, words)
        self.text = np.array(kept, np.int64)
        n, words = np.array(lengths, np.int64), np.array(flat, np.uint64)
        doc = np.repeat(np.arange(len(n)), n)
        ok = len(words) - width + 1
        if not len(n):
            self.hashes, self.start = np.zeros(0, np.uint64), np.zeros(1, np.int64)
            return
        h = words[:ok].copy()
        for k in range(1, width):
            h = h * _C[0] + words[k : ok + k] * _C[1] + np.uint64(k)
            h ^= h >> np.uint64(29)
        inside = doc[:ok] == doc[width - 1 :]
        h, doc = mixed(h[inside]), doc[:ok][inside]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hashes = h[first]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=len(n)))))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def owners(self) -> np.ndarray:
        """The set that each of ``hashes`` belongs to."""
        return np.repeat(np.arange(len(self.text)), self.sizes)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits per set that depend on its members only."""
        if not len(self.text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.start[:-1]
        high = np.add.reduceat(mixed(self.hashes ^ _C[0]), at)
        low = np.add.reduceat(mixed(self.hashes ^ _C[1]), at)
        return high.view(np.int64), low.view(np.int64)
