"""Words and word shingles of texts as 64-bit hashes, the same on every executor."""

import numpy as np
import xxhash

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; of all words together where there are fewer than n, of none for none."""
    n = min(n, len(hashes))
    count = len(hashes) - n + 1 if n else 0
    out = np.full(count, np.uint64(n))
    for k in range(n):
        out = (out ^ (out >> np.uint64(32))) * _MULTIPLY + hashes[k : k + count]
    return mixed(out)
