"""Results against brute force, exact round trips and held-out labels."""

import hashlib
import io
import math
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

from tabsleuth.llm import (imatch, langid, lines, mixing, neardup, packing, q_langid, q_toxicity, substrings, suffixes, topk, warc)
from tabsleuth.llm.common import table
from tabsleuth.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()


def _edits(rng, line, n):
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        line = line[:i] + (rng.choice("abcé") if kind else "") + line[i + (kind != 1):]
    return line


def _distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:] if i < len(b) else True


def test_lines_within_one_edit(spark, docs):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé d") for _ in range(rng.randrange(15, 90))).strip() for _ in range(25)]
    base += ["a" * 40, "a" * 41, "ab" * 20, "ab" * 20 + "a"]
    texts = []
    for i in range(60):
        texts.append((i, "\n".join(_edits(rng, rng.choice(base), rng.randrange(3)) for _ in range(rng.randrange(1, 5)))))
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    seen, near = [], 0
    for i, text in texts:
        stay = []
        for line in text.split("\n"):
            s = line.strip(" \t\r").lower()
            equal = s in seen
            close = len(s) >= lines.MIN_FUZZY and any(len(x) >= lines.MIN_FUZZY and _distance_at_most_one(s, x) for x in seen)
            near += close and not equal
            if not s or not (equal or close):
                stay.append(line)
            if s:
                seen.append(s)
        assert got[i] == "\n".join(stay), i
    assert near > 20


def test_short_lines_within_one_edit(spark):
    rng = random.Random(8)
    texts = [(i, "\n".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(4))) for i in range(30)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(texts, "doc_id long, text string"), min_fuzzy=4).collect()}
    seen = []
    for i, text in texts:
        stay = []
        for line in text.split("\n"):
            if not (line in seen or len(line) >= 4 and any(len(x) >= 4 and _distance_at_most_one(line, x) for x in seen)):
                stay.append(line)
            seen.append(line)
        assert got[i] == "\n".join(stay), i


def test_near_documents_against_all_pairs(docs, rows):
    shingles = {}
    for r in rows:
        w = (r.text or "").lower().split()
        n = min(neardup.WORDS, len(w))
        shingles[r.doc_id] = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()
    df = Counter(x for s in shingles.values() for x in s)
    least, rest = max(2, math.ceil(neardup.LOW * len(rows))), math.log1p(1 / neardup.LOW)
    weight = {i: {x: k * (math.log1p(len(rows) / df[x]) if df[x] >= least else rest) for x, k in s.items()} for i, s in shingles.items()}
    root = {i: i for i in weight}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(weight)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = sum(min(weight[a][x], weight[b][x]) for x in weight[a] if x in weight[b])
            union = sum(weight[a].values()) + sum(weight[b].values()) - common
            if (union and common / union >= neardup.SIMILARITY) or not union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {i: find(i) for i in weight}


def test_large_group_of_near_copies(spark):
    """Members differ from a common text, and less from it than from each other."""
    ship_package(spark)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(300)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    # All weights are equal but those of shingles in a tenth of the texts or more, which all members share.
    idf = Counter()
    sets = {}
    for i, t in texts:
        w = t.split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        idf.update(sets[i])
    weight = {x: math.log1p(min(len(texts) / n, 1 / neardup.LOW)) for x, n in idf.items()}
    total = {i: sum(weight[x] for x in s) for i, s in sets.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(700):
        for j in range(i):
            common = sum(weight[x] for x in sets[i] & sets[j])
            if common >= 0.8 * (total[i] + total[j] - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}
    assert 10 < len({find(i) for i in range(700)}) < 400


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(200):
        k = rng.choice([1, 2, 3, 20])
        b = bytes(rng.randint(97, 96 + k) for _ in range(rng.randint(1, 150)))
        if rng.random() < 0.5:
            b = b + b[:len(b) // 2] + b"\xff" + b
        t = np.frombuffer(b, np.uint8)
        sa = suffixes.suffix_array(t, len(t) + 1)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        n = rng.randint(1, 6)
        before = {int(y): int(x) for x, y in zip(sa[:-1], sa[1:])}
        want = [i in before and len(b[i:i + n]) == n and b[i:i + n] == b[before[i]:before[i] + n] for i in range(len(b))]
        assert suffixes.reaching(t, sa, n).tolist() == want


def _repeated_bytes(texts, length):
    times = Counter()
    for b in texts.values():
        times.update(b[j:j + length] for j in range(len(b) - length + 1))
    out = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if times[b[j:j + length]] > 1:
                gone[j:j + length] = True
        out[i] = gone
    return out


@pytest.mark.parametrize("many", [4096, 3])
def test_substrings_against_all_strings(docs, rows, monkeypatch, many):
    """Also with few contexts for a fingerprint, so that the rest is counted by hashes."""
    monkeypatch.setattr(substrings, "MANY", many)
    texts = {r.doc_id: (r.text or "").encode() for r in rows}
    got = {r.doc_id: r for r in substrings.dedup(docs).collect()}
    removed = 0
    for i, gone in _repeated_bytes(texts, substrings.LENGTH).items():
        kept = bytes(x for x, g in zip(texts[i], gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(texts[i]), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
        removed += int(gone.sum())
    assert removed > 0


def test_fingerprints_follow_descending_ids(docs, rows):
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -r.doc_id)
    for i, r in enumerate(order):
        text, after = r.text or "", order[(i + 1) % len(order)].text or ""
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        assert got[r.doc_id].n_chars == len(text)
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    edited, following = (np.mean([getattr(r, c) for r in got.values()]) for c in ("near_edited", "near_next"))
    assert edited > 3 * following


def test_language_held_out(spark):
    ship_package(spark)
    got = [r for r in q_langid.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    lang = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97


def test_bloom_masks_hold_every_language(docs):
    model = langid.learn(docs)
    keys, _ = langid.trigrams(["the and of", "das ist der"])
    assert len(keys) and model.words.shape[1] == 1 << langid.SLOT_BITS
    assert (model.false < 0.01).all()
    masks = model.words[0][langid.slots_of(keys, model.slot_bits)[0]]
    assert (masks > 0).mean() > 0.8


def test_trigrams_keep_texts_apart():
    for texts in (["ab c", "", "d!", "12", "xyz\x00q"], ["a"], [""]):
        keys, doc = langid.trigrams(texts)
        alone = [langid.trigrams([t])[0].tolist() for t in texts]
        assert [keys[doc == i].tolist() for i in range(len(texts))] == alone
    assert langid.trigrams(["a"])[0].tolist() == [ord("a") << 21]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    ship_package(spark)
    got = {r.doc_id: r for r in q_toxicity.query(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    hits = sum(p and y for p, y in held)
    # At this size a quarter of the toxic labels are on texts without any toxic word.
    assert hits / max(1, sum(y for _, y in held)) > 0.65
    assert hits / max(1, sum(p for p, _ in held)) > 0.9


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.asarray(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids) and len(pieces) == -(-len(ids) // packing.CAPACITY)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    bound = packing.lower_bound(np.bincount([r.length for r in got], minlength=packing.CAPACITY + 1), packing.CAPACITY)
    assert len(by_seq) <= bound * 1.01 + 1


def test_lower_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(60):
        cap = int(rng.integers(5, 60))
        x = np.sort(rng.integers(1, cap + 1, int(rng.integers(1, 40))))[::-1]
        bins, offsets, free = packing.best_fit_decreasing(x, cap)
        assert packing.lower_bound(np.bincount(x, minlength=cap + 1), cap) <= len(free)
        assert all(x[bins == b].sum() == cap - free[b] for b in range(len(free)))
    assert packing.lower_bound(np.bincount([6, 6, 6, 5], minlength=11), 10) == 4       # no two of these fit into 10


def test_words_tokenise_like_texts():
    enc = packing.WordIds(packing.default_tokenizer())
    texts = ["  a  b \n c", "\ta b", " a", "a ", "\n\n x  y z it's don't", "a \n", "x\r\n y", "", " ", "  ", "don't  stop 's 12  3",
             "a　b c\u0085 d", "a b<|endoftext|> c", "日本 語 🙂 x", "a b c d"]
    for t, raw in zip(texts, enc.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t


def test_mixing_meets_targets(docs):
    got = mixing.mix(docs).collect()
    total = sum(r.size * r.rows for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        taken = sum((r.epochs * r.size + r.part_words) * r.rows for r in v)
        assert 0 <= v[0].target - taken < 2 and v[0].target <= 3 * v[0].source_size + 1e-9
        partly = [r for r in v if 0 < r.part_words < r.size]
        assert len(partly) <= 1 and len({r.epochs for r in v}) == 1


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 6.0, "b": 12.0, "c": 3.0, None: 0.0}


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n\tc  d ",)], "t string")
    cut = [df.select(mixing.first_words(mixing.F.col("t"), mixing.F.lit(n))).first()[0] for n in (1, 3, 4)]
    assert cut == ["  a", "  a b\n\tc", "  a b\n\tc  d"]


def test_quality_draws_first(spark):
    """Better documents are taken more often."""
    ship_package(spark)
    docs = spark.createDataFrame([(i, "one two three", "s0" if i < 600 else "s1") for i in range(1200)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 0.25) for i in range(1200)], "doc_id long, weight double")
    got = [r for r in mixing.mix(docs, quality, weights=(1.0, 2.0)).collect() if r.source == "s0" and r.part_words]
    assert np.mean([r.doc_id % 2 for r in got]) > 0.7          # two thirds of all are taken


def test_top_k_with_large_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)      # several blocks of queries
    ship_package(spark)
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(900, 6))
    vec[100:700] = vec[100]
    vec[3] *= 1e6
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vec)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 50 == 0, k=5).collect()
    q = np.floor(256 * vec).astype(np.int64)
    want = []
    for i in range(0, 900, 50):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(900) if j != i)[:5]
        want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_zip_directories(monkeypatch):
    """Plain and ZIP64 directories, a comment, and a member that is not stored."""
    for wide in (False, True):
        if wide:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("archive/a", b"x" * 100)
            z.writestr("archive/b", b"0123456789" * 5)
            z.writestr("indexes/i", b"deflated " * 50, compress_type=zipfile.ZIP_DEFLATED)
            z.comment = b"a comment"
        data = raw.getvalue()
        f = io.BytesIO(data)
        found = warc.members(f, len(data))
        assert list(found) == ["archive/a", "archive/b", "indexes/i"]
        at = warc.stored_at(f, found["archive/b"])
        assert data[at:at + 50] == b"0123456789" * 5
        assert (b"PK\x06\x06" in data) == wide
        with pytest.raises(ValueError):
            warc.stored_at(f, found["indexes/i"])
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no archive"), 10)


def test_packages_split_and_join(spark):
    ship_package(spark)
    pages = table(spark, SF, "pages")
    manifest = warc.write(warc.decide(pages), package_bytes=20_000)
    got = {r.page_id: r for r in warc.read_records(warc.read_index(manifest)).collect()}
    assert manifest.count() > 3
    html = {r.page_id: r.html or "" for r in pages.collect()}
    assert set(got) == set(html)
    for i, r in got.items():
        if r.record_type == "response":
            assert bytes(r.payload).decode() == html[i]
        else:
            assert html[r.refers_to] == html[i] and r.refers_to > i
