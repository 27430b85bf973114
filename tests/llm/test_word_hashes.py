"""Hashes of words."""

import numpy as np
import xxhash

from tabsleuth.llm import words


def test_word_hashes():
    given = ["a", "b", "a", "größe", "日本", "x" * 5000]
    got = words.word_hashes(given)
    assert got.dtype == np.uint64 and got.tolist() == [xxhash.xxh64_intdigest(w) for w in given]
    assert words.word_hashes([]).dtype == np.uint64 and len(words.word_hashes([])) == 0
