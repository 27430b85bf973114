"""Only strings that may differ are sorted (op5)."""

import random

import pandas as pd

from tabsleuth.llm import substrings


def test_only_contested_contexts_are_sorted(monkeypatch):
    rng = random.Random(4)
    n = substrings.LENGTH
    text = bytes(rng.randrange(97, 123) for _ in range(3 * n))
    alone, left, right = text[:n + 30], text[2 * n - 50:3 * n], text[2 * n - 50:3 * n - 20] + b"!" * 20
    sorted_bytes = []
    real = substrings.suffix_array

    def counted(t, depth):
        sorted_bytes.append(len(t))
        return real(t, depth)
    monkeypatch.setattr(substrings, "suffix_array", counted)
    rows = [(1, 1, 1, 5, alone), (2, 1, 1, 1, left), (2, 1, 2, 1, right), (3, 1, 1, 2, text[:n]), (3, 1, 2, 1, text[n:2 * n + 7])]
    got = substrings._shard(pd.DataFrame(rows, columns=["f", "c1", "c2", "n", "context"]))
    spans = {(f, c2): [(x["s"], x["e"]) for x in s] for f, c2, s in got[["f", "c2", "spans"]].itertuples(index=False)}
    common = n + 50 - 20 - n + 1
    assert spans == {(1, 1): [(0, 31)], (2, 1): [(0, common)], (2, 2): [(0, common)], (3, 1): [(0, 1)], (3, 2): []}
    # copies and the only context of a fingerprint are not sorted
    assert sum(sorted_bytes) == len(left) + len(right) + n + (n + 7) + 4
