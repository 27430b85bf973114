"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest

from tabsleuth.llm import imatch, langid, lines, mixing, neardup, packing, substrings, topk, toxicity, warc
from tabsleuth.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h1 long, node string, draw int, kept int"
LONG = " ".join(f"word{i % 97} thing{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def make(spark):
    ship_package(spark)

    def build(rows):
        return spark.createDataFrame([(i, t, g, s, len(t or ""), "k", 1, "n", 2, 3) for i, t, g, s in rows], SCHEMA)
    return build


@pytest.fixture(scope="module")
def odd(make):
    """Null ids, texts, languages and sources; an empty text, blanks, a long text, and a row three times."""
    return make([(1, "a line of some length here\nanother line of text there", "en", "x"),
                 (2, None, "en", "x"), (3, "", None, None), (None, "no id at all here", "de", "y"), (4, " \n\t ", "en", "y"),
                 (5, LONG, "en", "x"), (6, "same text twice over", "en", "z"), (6, "same text twice over", "en", "z"),
                 (6, "same text twice over", "en", "z"), (7, "same text twice over", None, "z"), (8, "x\x00y \U0001f600 日本", "ja", "z")])


@pytest.fixture(scope="module")
def empty(spark):
    ship_package(spark)
    return spark.createDataFrame([], SCHEMA)


def test_lines(odd, empty):
    out = {(r.doc_id, i): r for i, r in enumerate(lines.dedup(odd).collect())}
    assert len(out) == 11
    by = {}
    for (doc, _), r in out.items():
        by.setdefault(doc, []).append(r)
    assert by[2][0].text is None and by[2][0]["__lines"] == 0
    assert by[4][0].text == " \n\t "                                   # blank lines stay
    assert [r.text for r in by[6]] == ["same text twice over"] * 3     # copies of one row share its result
    assert by[7][0].text == "" and by[7][0]["__removed"] == 1
    assert by[5][0].text == LONG
    assert by[1][0].key == "k" and by[1][0].node == "n"                # extra columns are kept
    assert lines.dedup(empty).count() == 0


def test_mixing(odd, empty):
    rows = mixing.mix(odd).collect()
    assert sum(r.rows for r in rows) == 11
    size = {r.doc_id: r.size for r in rows if r.doc_id is not None}
    assert size[2] == 0 and size[3] == 0 and size[4] == 0 and size[1] == 11 and size[6] == 4
    for r in rows:
        assert 0 <= r.epochs * r.size + r.part_words <= 3 * r.size
    assert {r.source for r in rows} == {"x", "y", "z", None}
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0


def test_packing(odd, empty):
    rows = packing.pack_documents(odd, capacity=64).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    one = [r for r in rows if r.doc_id == 2]
    assert [(r.piece, r.start, r.length) for r in one] == [(0, 0, 1)]
    assert len([r for r in rows if r.doc_id == 6]) == 3
    assert any(r.doc_id is None for r in rows)
    assert packing.pack_documents(empty).count() == 0


def test_near_documents(odd, empty):
    rows = neardup.classes(odd).collect()
    cls = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert cls[6] == cls[7] == 6
    assert cls[2] == cls[3] == cls[4] == 2                             # texts without words are equal
    assert cls[5] == 5 and cls[1] == 1
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 2, 5, 6, 8]
    assert neardup.classes(empty).count() == 0


def test_substrings(odd, empty, make):
    rows = {r.doc_id: r for r in substrings.dedup(odd).collect()}
    assert rows[2].n_bytes == 0 and rows[3].n_removed == 0
    assert rows[5].n_removed > 0                                       # its words repeat in a cycle
    twice = substrings.dedup(make([(1, "ab" * 300, "en", "x")] * 2)).collect()
    assert [r.n_removed for r in twice] == [600, 600] and [r.n_spans for r in twice] == [1, 1]
    assert substrings.dedup(empty).count() == 0


def test_fingerprints(odd, empty, make):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == 11
    same = {r.fingerprint for r in rows if r.doc_id in (6, 7)}
    assert len(same) == 1
    assert imatch.fingerprints(empty).count() == 0
    alone = imatch.fingerprints(make([(1, "one two three four", "en", "x")])).collect()
    assert alone[0].near_next == 1.0                                   # its next document is itself


def test_language(odd, empty):
    model = langid.learn(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == 11
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = langid.identify(odd, langid.learn(empty)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (6, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 11 and all(0 <= r["__score"] <= 1 for r in rows)
    no_labels = toxicity.learn(odd, labels.limit(0))
    assert {r["__score"] for r in toxicity.score(odd, no_labels).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_top_k(spark):
    ship_package(spark)
    schema = "vec_id long, embedding array<float>, score int, rank string, g int, dim int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]),
            (7, [inf, 0.0]), (8, [1.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.25]), (50, [])]
    v = spark.createDataFrame([(i, x, 1, "r", 2, 3) for i, x in rows], schema)
    out = sorted(tuple(r) for r in topk.top_k(v, lambda c: c % 50 == 0, k=3).collect())
    assert out == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 3, 32768)]
    assert topk.top_k(v.limit(0), lambda c: c % 50 == 0, k=3).count() == 0


def test_warc(spark):
    ship_package(spark)
    pages = spark.createDataFrame(
        [(1, "http://a/ b", "<p>x</p>", "t"), (2, None, "<p>x</p>", "t"), (3, "u", None, "t"), (4, "u", "", "t"), (None, "u", "<p>x</p>", "t"),
         (5, "v", "é" * 200_000, "t"), (5, "v", "é" * 200_000, "t")], "page_id long, url string, html string, payload string")
    manifest = warc.write(warc.decide(pages))
    got = {}
    for r in warc.read_records(warc.read_index(manifest)).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert got == {1: [(8, "revisit", 2)], 2: [(8, "response", None)], None: [(8, "revisit", 2)], 3: [(0, "revisit", 4)], 4: [(0, "response", None)],
                   5: [(400_000, "response", None)] * 2}
    assert warc.read_records(warc.read_index(warc.write(warc.decide(pages.limit(0))))).count() == 0
