"""The corpus pipeline: its stages in order on a small corpus, against plain recomputation, and on odd tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline as CP
from tabsleuth.llm import mixing, packing
from tabsleuth.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC = ["stupid", "worthless", "hateful"]


def _words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts, repeated lines, near copies and a hot source."""
    ship_package(spark)
    rng = random.Random(11)
    rows, toxic = [], {}
    line = "this very line stands in many of the documents"
    for i in range(240):
        text = "\n".join(_words(rng, 40) for _ in range(3))
        if i % 6 == 0:
            text = f"{text}\n{line}"
        bad = i % 8 == 3
        if bad:
            text = " ".join(x for w in text.split(" ") for x in (w, rng.choice(TOXIC)))
        rows.append((i, text, "en", "big" if i % 3 else f"s{i % 5}"))
        toxic[i] = int(bad)
    near = {}
    for i in range(300, 330):                              # near copies of clean documents: one word differs
        of = next(j for j in rng.sample(range(240), 240) if not toxic[j] and j % 6)
        w = rows[of][1].split(" ")
        w[rng.randrange(5, 100)] = "changed"
        rows.append((i, " ".join(w), "en", "copies"))
        near[i] = of
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, docs, toxic, near, line


def test_stages(spark, corpus):
    folder, docs, toxic, near, line = corpus
    kept = docs
    seen = {}
    for name, stage in CP.STAGES[:-1]:
        kept = CP.materialize(stage(spark, kept, folder), f"test-{name}")
        assert kept.columns == docs.columns, name
        seen[name] = kept.collect()
    names = [n for n, _ in CP.STAGES]
    assert names == ["drop_toxic", "dedup_lines", "dedup_documents", "mix_sources", "pack"]
    # 2: toxic documents go, clean ones stay
    left = {r.doc_id for r in seen["drop_toxic"]}
    clean = {i for i, y in toxic.items() if not y} | set(near)
    assert len(left - clean) <= 0.1 * sum(toxic.values()) and len(clean - left) <= 0.02 * len(clean)
    # 1: each line once, at its first document; a near copy loses the lines that it shares
    lines = Counter(x for r in seen["dedup_lines"] for x in r.text.split("\n") if x.strip())
    assert set(lines.values()) == {1} and lines[line] == 1
    first = min(i for i in left if i % 6 == 0 and i < 300)
    assert line in next(r.text for r in seen["dedup_lines"] if r.doc_id == first)
    assert all(r.n_chars == len(r.text) for r in seen["dedup_lines"])
    # 10: what is left of a copy is its changed line; no clean original goes
    assert {r.doc_id for r in seen["dedup_documents"] if r.doc_id < 240} == {r.doc_id for r in seen["dedup_lines"] if r.doc_id < 240}
    # 3: the mix takes each source's target in words, from what the stage before kept
    size = Counter()
    for r in seen["dedup_documents"]:
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in seen["mix_sources"]:
        taken[r.source] += len(r.text.split())
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(sorted(size))}
    target, open_, rest = {}, set(size), float(sum(size.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        rest, open_ = rest - sum(3.0 * size[s] for s in over), open_ - over
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    # 9: every piece of every row of the mix is placed once, without gaps
    rows = CP.STAGES[-1][1](spark, kept, folder).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in seen["mix_sources"])
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= packing.CAPACITY


def test_near_copies_that_share_no_line_go(spark, corpus):
    folder, docs, _, _, _ = corpus
    rng = random.Random(3)
    base = [f"v{rng.randrange(4000)}" for _ in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    alone = [(100 + i, _words(rng, 120), "en", "s", 0) for i in range(20)]
    kept = CP.dedup_documents(spark, spark.createDataFrame(rows + alone, SCHEMA), folder).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(100, 120)]


@pytest.mark.parametrize("stage", [s for s, _ in CP.STAGES])
def test_odd_tables(spark, corpus, stage):
    folder, docs, _, _, _ = corpus
    run = dict(CP.STAGES)[stage]
    wide = SCHEMA + ", key string, h1 long, node string, toxic int, size int, rank int"
    more = ("k", 1, "n", 0, 2, 3)
    rows = [(1, "some text that stands here\nand a second line of it", "en", "x", 5, *more), (2, None, None, None, None, *more), (3, "", "en", "x", 0, *more),
            (None, "a text without an id at all", "en", None, 1, *more), (4, "twice the same text in two rows", "en", "y", 1, *more),
            (4, "twice the same text in two rows", "en", "y", 1, *more), (5, "long " * 20_000, "en", "y", 1, *more)]
    odd = spark.createDataFrame(rows, wide)
    out = run(spark, odd, folder)
    got = out.collect()
    if stage != "pack":
        assert out.columns == odd.columns and {r.doc_id for r in got} <= {1, 2, 3, None, 4, 5}
    if stage in ("drop_toxic", "pack"):
        assert {r.doc_id for r in got} == {1, 2, 3, None, 4, 5}
    if stage == "dedup_documents":
        assert sum(r.doc_id == 4 for r in got) == 1
    assert run(spark, odd.limit(0), folder).count() == 0


def test_run(spark, corpus):
    folder, _, _, _, _ = corpus
    assert CP.run(spark, folder).count() > 0
    assert mixing.QUALITY and CP.ORACLE_SQL is None
