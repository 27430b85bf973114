"""Words and their hashes inside Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word.  Hashing costs less than remembering: real vocabularies outgrow a bounded memory."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed) * MIX) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x
