"""Divergence audit, importance resampling and license scan: against SQL, brute force and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tabsleuth.llm import divergence, licenses, q_divergence, q_licenses, q_resample, resample
from tabsleuth.llm.common import table
from tabsleuth.session import ship_package

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n int, h1 string, rank int, blocks int, label string"


@pytest.fixture(scope="module")
def make(spark):
    ship_package(spark)

    def build(rows):
        return spark.createDataFrame([(i, t, g, s, 1, "t", 1, "h", 7, 2, "l") for i, t, g, s in rows], SCHEMA)
    return build


@pytest.fixture(scope="module")
def odd(make):
    return make([(1, "a line of words here\nanother line of words there", "en", "x"), (2, None, "en", "x"), (3, "", None, None),
                 (None, "no id at all here", "de", "y"), (4, " \n\t ", "en", "y"), (5, " ".join(f"word{i % 97} thing{i % 31}" for i in range(30_000)), "en", "x"),
                 (6, "same text twice over " * 6, "en", "z"), (6, "same text twice over " * 6, "en", "z"), (7, "same text twice over " * 6, None, "z"),
                 (8, "x\x00y \U0001f600 日本 ÀÉ", "ja", "z")])


def _same(got, want):
    def plain(v):
        if v is None or v != v:
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else round(v, 6) if isinstance(v, float) else v

    def rows(pdf):
        return sorted((tuple(plain(r[c]) for c in sorted(pdf.columns)) for r in pdf.astype(object).to_dict("records")), key=str)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("module", [q_divergence, q_licenses, q_resample])
def test_against_sql(spark, duck, module):
    ship_package(spark)
    _same(module.query(spark, SF).toPandas(), duck.execute(module.SQL).fetchdf())


# --- divergence -----------------------------------------------------------------

def _brute_report(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    docs = [(g or "", s or "", term.findall((t or "").translate(low))) for _, t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        df = Counter(w for g, _, ws in docs if g == lang for w in set(ws))
        kept = [w for w, n in df.items() if n >= min_docs]
        sources = sorted({s for g, s, _ in docs if g == lang}, key=str.encode)

        def shares(which):
            n = Counter(w for g, s, ws in docs if g == lang and s in which for w in ws)
            total = sum(n[w] for w in kept) + 5 * len(kept)
            return n, {w: 1 + 10 ** 9 * (n[w] + 5) // total for w in kept}
        _, q = shares(sources)
        p = {s: shares([s]) for s in sources}
        for s in sources:
            pair = sorted(((sum(abs(p[s][1][w] - p[o][1][w]) for w in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            more = sorted(((p[s][1][w] - q[w], w) for w in kept if p[s][0][w] and p[s][1][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pair)]
            out += [(lang, s, "term", w, v, k + 1) for k, (v, w) in enumerate(more[:top])]
    return sorted(out)


def test_divergence_over_many_blocks(make):
    """Blocks so small that every pair of sources meets in several cells."""
    rng = random.Random(8)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["É", "日本", "Zed", "zed"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice([f"s{j}" for j in range(9)] + [None]))
            for i in range(150)]
    rows += [(i, "the the hot", "en", "s0") for i in range(200, 300)]             # one source holds two fifths of all rows
    got = divergence.report(make(rows), top_terms=7, min_docs=5, terms_per_block=4, groups_per_block=2)
    assert sorted(map(tuple, got.collect())) == _brute_report(rows, 5, 7)


def test_divergence_pairs_have_one_direction():
    """The rows of a cell come in any order; the parts of a pair must meet under one key."""
    import pandas as pd
    rows = pd.DataFrame({"source": ["b", "a", "c"], "gblock": [0, 0, 0], "total": [3, 5, 0], "vocabulary": [2, 2, 2], "n_terms": [2, 2, 2],
                         "ids": [[0], [0, 1], None], "ns": [[3], [2, 3], None]})
    want = divergence._cell(("en", 0, 0, 0), rows)
    assert list(zip(want["a"], want["b"])) == [("a", "b"), ("a", "c"), ("b", "c")]
    for order in ([2, 1, 0], [1, 0, 2], [0, 2, 1]):
        pd.testing.assert_frame_equal(divergence._cell(("en", 0, 0, 1), rows.iloc[order]), want)


def test_divergence_odd_tables(odd, make):
    got = sorted(map(tuple, divergence.report(odd, min_docs=1).collect()))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    assert got == _brute_report(rows, 1, 50)
    none = divergence.report(odd).collect()                                   # no term in 30 documents: all shares are equal
    assert none and {r.value for r in none} == {0} and {r.part for r in none} == {"pair"}
    assert divergence.report(odd.limit(0)).count() == 0


def test_shares_of_large_counts():
    import numpy as np
    n = np.array([0, 1, 10 ** 14, 3 * 10 ** 15], np.int64)
    below = np.array([4 * 10 ** 15 + 7] * 4, np.int64)
    assert divergence._shares(n, below).tolist() == [1 + 10 ** 9 * (int(x) + 5) // (4 * 10 ** 15 + 7) for x in n]


# --- resampling -----------------------------------------------------------------

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _features(text, max_n, buckets):
    w = WORD.findall((text or "").encode().lower())
    grams = [b" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    return len(w), Counter(zlib.crc32(g) % buckets for g in grams)


def _brute_draw(rows, target, max_n, buckets, percent, least):
    found = [(i, *_features(t, max_n, buckets)) for i, t in rows]
    s = sum((f for _, _, f in found), Counter())
    t = sum((_features(x, max_n, buckets)[1] for x in target), Counter())
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big + buckets) / ((s[b] + 1.0) * (small + buckets)))) for b in s}
    out = []
    for i, n, f in found:
        weight = sum(k * gain[b] for b, k in f.items())
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return sorted(out, key=str), [r[:2] + (r[4],) for r in drawn]


@pytest.mark.parametrize("max_n", [1, 3])
def test_draw_against_brute_force(spark, make, max_n):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(50)] + ["É", "A1", "x"]
    common = ["a common line of words", "", "x", "one two"]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 6))] + rng.choices(common, k=rng.randrange(0, 3))
        rng.shuffle(parts)
        rows.append((i, rng.choice(["\n", "\n\n", " \n"]).join(parts)))
    rows += [(i, "a common line of words\n" * 8) for i in range(200, 260)]          # a third of all rows are copies
    rows += [(300, None), (301, ""), (None, "no id " * 12), (7, "again " * 30), (7, "again " * 30)]
    target = ["word1 word2 word3 x", None, "", "A1 É\nword1 word2"]
    want, drawn = _brute_draw(rows, target, max_n, 97, 30, 10)
    got = resample.draw(make([(i, t, "en", "s") for i, t in rows]), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"),
                        max_n=max_n, buckets=97, percent=30, min_words=10).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=str) == want
    assert [(r.doc_id, r.n_words, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_line_features_are_counted_once(make):
    docs = make([(i, "one two\nthree\none two", "en", "s") for i in range(5)] + [(9, "three", "en", "s")])
    lines = {r.n_words: (r.n, r.n_grams) for r in resample.line_counts(docs, max_n=2).collect()}
    assert lines == {2: (10, 3), 1: (6, 1)}
    assert resample._crossing("a b\n\nc\nd e f g", 3) == [b"b c", b"c d", b"a b c", b"b c d", b"c d e"]


def test_resample_odd_tables(odd):
    got = resample.draw(odd, odd.select("text").limit(0)).collect()
    assert len(got) == 10 and {r.doc_id for r in got} == {1, 2, 3, None, 4, 5, 6, 7, 8}
    assert [(r.n_words, r.weight, r["rank"]) for r in got if r.doc_id == 2] == [(0, 0, None)]
    assert len({(r.n_features, r.weight, r.score) for r in got if r.doc_id == 6}) == 1
    assert resample.draw(odd.limit(0), odd).count() == 0


# --- licenses -------------------------------------------------------------------

def _brute_notices(rows, templates, threshold):
    out = set()
    prepared = licenses.prepared(templates, threshold)
    for i, text in rows:
        w = [x.decode() for x in WORD.findall((text or "").encode().lower())]
        for _, t in prepared.iterrows():
            for start in range(0, len(w), t.stride):
                block = set(w[start:start + 2 * t.stride])
                n = len(block & set(t.words))
                if n >= threshold * len(t.words) - 1e-9:
                    out.add((i, start, len(w[start:start + 2 * t.stride]), t.template, t.label, round(n / len(t.words), 9)))
    return out


def test_notices_against_all_pairs(make):
    rng = random.Random(6)
    filler = [f"f{i}" for i in range(30)] + "the of and this in any to use software license permission is copy".split()
    rows = []
    for i in range(150):
        w = rng.choices(filler, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 4)):
                notice[rng.randrange(len(notice))] = rng.choice(filler)
            at = rng.randrange(len(w) + 1)
            w[at:at] = notice
        rows.append((i, rng.choice([" ", "\n", ", "]).join(w).replace("software", "Software")))
    docs = make([(i, t, "en", "s") for i, t in rows])
    for threshold in (0.9, 0.6):
        want = _brute_notices(rows, None, threshold)
        got = {(*tuple(r)[:5], round(r.containment, 9)) for r in licenses.notices(docs, threshold=threshold).collect()}
        assert got == want and len(want) > 40
    own = [("t", "alpha beta gamma delta epsilon"), ("empty", " ,; "), ("one", "zeta")]
    some = make([(1, "x alpha beta gamma delta y", "en", "s"), (2, "Zeta", "en", "s"), (3, "alpha beta gamma", "en", "s")])
    assert {(r.doc_id, r.label) for r in licenses.notices(some, templates=own, threshold=0.8).collect()} == {(1, "t"), (2, "one")}


def test_labels_keep_the_base(make):
    docs = make([(1, "The MIT-License; mit license", "en", "s"), (2, "CC BY-NC, cc\nby. GNU General Public License", "en", "s"),
                 (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                     "files (the \"Software\"), to deal in the Software without restriction", "en", "s"), (4, "submit licenses to the mit", "en", "s")])
    got = {r.doc_id: tuple(r)[1:] for r in licenses.label(docs).collect()}
    assert got[1] == (5, 2, 1, 3, "mit", "mit", 1.0)
    assert got[2] == (9, 3, 0, 5, "cc-by,gpl", "cc-by,gpl", 1.0)
    assert got[3][1:6] == (0, None, None, "", "mit") and got[3][6] == 1.0
    assert got[4] == (5, 0, None, None, "", "", 0.0)


def test_licenses_odd_tables(odd):
    got = licenses.label(odd).collect()
    assert len(got) == 10 and {r.score for r in got} == {0.0}
    assert [tuple(r)[1:] for r in got if r.doc_id == 2] == [(0, 0, None, None, "", "", 0.0)]
    assert [r.n_words for r in got if r.doc_id == 5] == [60_000]
    assert licenses.label(odd.limit(0)).count() == 0
    assert {r.labels for r in licenses.label(odd, templates=[]).collect()} == {""}


# --- mended cases of earlier operators ----------------------------------------------

def test_special_token_texts_are_packed_as_the_tokenizer_reads_them(make):
    import numpy as np
    from tokenizers import Tokenizer

    from tabsleuth.llm import packing
    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a b<|endoftext|> c", "<|endoftext|>", "plain text", "x <|endoftext|><|endoftext|>"]
    got = {r.doc_id: r for r in packing.pack_documents(make([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert got[i].length == len(ids) and got[i].ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_vectors_of_many_lengths(spark):
    from tabsleuth.llm import topk
    ship_package(spark)
    rows = [(i, [1.0 / (1 + i % 7)] * dim) for i, dim in enumerate([5000, 5001, 5000, 5001, 4095, 4094, 4095])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 2 == 0, k=2).collect()
    v = {i: [int(256 * x) for x in e] for i, e in rows}
    want = [(q, n + 1, i, s) for q in v if q % 2 == 0
            for n, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q])), key=lambda x: (-x[0], x[1]))[:2])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_fingerprints_of_equal_ids(make):
    from tabsleuth.llm import imatch
    rows = [(None, f"text number {i} of some words here", "en", "s") for i in range(40)] + [(5, f"other text {i}", "en", "s") for i in range(30)]
    docs = make(rows + [(i, f"plain {i}", "en", "s") for i in range(10, 30)])
    placed = imatch._in_order(docs)
    assert len({r[0] for r in placed.select("bucket").collect()}) > 40              # null ids are not one bucket
    got = imatch.fingerprints(docs).collect()
    assert len(got) == 90 and sum(r.doc_id is None for r in got) == 40
    order = sorted(((r.doc_id if r.doc_id is not None else -2 ** 63, h, r.text) for r, h in
                    ((r, r.h) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect())), reverse=True)
    texts = [t for _, _, t in order]
    want = sorted(hashlib.sha256(imatch.edited(t, texts[(k + 1) % len(texts)]).encode()).hexdigest() for k, t in enumerate(texts))
    assert sorted(r.edited_sha256 for r in got) == want


def test_copies_of_a_labelled_row_are_one_row(spark, make):
    from tabsleuth.llm import toxicity
    docs = make([(4, "a text that is copied", "en", "s")] * 150 + [(i, f"clean text {i}", "en", "s") for i in range(100, 120)])
    labels = spark.createDataFrame([(4, 1)] + [(i, 0) for i in range(100, 120)], "doc_id long, toxic int")
    rows, _ = toxicity._labelled(docs, labels, 50)
    assert len(rows) == rows["doc_id"].nunique() and len(rows) <= 21
    plan = rows  # the rows came through a join of 150 copies with 150 copies
    assert plan["text"].nunique() == len(rows)


def test_a_language_of_two_texts_is_learned(make):
    from tabsleuth.llm import langid
    rows = [(i, f"the water and the stone of the house number {i}", "en", "s") for i in range(60)]
    rows += [(100, "das wasser und der stein", "de", "s"), (101, "der stein und das haus", "de", "s")]
    model = langid.learn(make(rows))
    assert langid.identify(make([(1, "das wasser und der stein", None, "s"), (2, "the stone of the house", None, "s")]), model).toPandas().set_index("doc_id")["lang_pred"].to_dict() == {
        1: "de", 2: "en"}
